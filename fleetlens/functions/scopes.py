"""Units of T-SQL scripts with the scope that each stands in, as rows.

A unit is a token, or several that belong together: a dotted name, a comparison
of two signs, a string with its N. What a filter over rows can't see, brackets
and the clause that a keyword opens, is worked out here in one pass over a
script; all that the rules look for is left to columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.spread import evenly, spread
from fleetlens.functions.tsql import batches as cut
from fleetlens.functions.tsql import tokenize

#: Neighbours handed on with each unit.
BACK, AHEAD = 5, 12
#: Words that begin a statement.
STARTS = frozenset("SELECT INSERT UPDATE DELETE MERGE EXEC EXECUTE ALTER CREATE DROP TRUNCATE DENY GRANT REVOKE DECLARE SET BEGIN END COMMIT ROLLBACK SAVE PRINT RAISERROR THROW IF ELSE WHILE RETURN USE OPEN FETCH CLOSE DEALLOCATE DBCC BREAK CONTINUE GOTO WAITFOR KILL BACKUP RESTORE RECONFIGURE REVERT".split())
#: Words that name no column, table or alias.
RESERVED = STARTS | frozenset("ADD ALL AND ANY AS ASC AUTHORIZATION BETWEEN BY CASE CHECK CLUSTERED COLLATE COLUMN CONSTRAINT CONTAINS CROSS CURRENT CURSOR DATABASE DEFAULT DESC DISTINCT ESCAPE EXCEPT EXISTS FOR FOREIGN FROM FULL FUNCTION GROUP HAVING HOLDLOCK IDENTITY IN INDEX INNER INTERSECT INTO IS JOIN KEY LEFT LIKE NOCHECK NONCLUSTERED NOT NULL OF OFF OFFSET ON OPTION OR ORDER OUTER OUTPUT OVER PARTITION PERCENT PIVOT PRIMARY PROC PROCEDURE REFERENCES RIGHT ROWS RULE SCHEMA SOME STATISTICS TABLE THEN TO TOP TRAN TRANSACTION TRIGGER UNION UNIQUE UNPIVOT USING VALUES VIEW WHEN WHERE WITH WITHIN APPLY GO".split())
_NOT_ALIAS = RESERVED | {"LOOP", "HASH", "REMOTE", "MATCHED", "TABLESAMPLE", "NEXT", "WINDOW", "ANTI", "SEMI"}
_MODULES = {"PROC": "PROCEDURE", "PROCEDURE": "PROCEDURE", "FUNCTION": "FUNCTION", "TRIGGER": "TRIGGER", "VIEW": "VIEW"}
#: Databases and schemas of the server itself.
_SYSTEM = {"SYS", "INFORMATION_SCHEMA", "MSDB", "MASTER", "MODEL", "TEMPDB"}

FIELDS = [("n", pa.int32()), ("kind", pa.string()), ("v", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("w", pa.list_(pa.string())), ("batch", pa.int32()), ("module", pa.string()), ("stmt", pa.int32()), ("head", pa.string()), ("first", pa.bool_()), ("depth", pa.int32()), ("open", pa.int32()), ("fn", pa.string()), ("item", pa.int32()), ("place", pa.int32()), ("block", pa.int32()), ("own", pa.bool_()), ("verb", pa.string()), ("clause", pa.string()), ("cond", pa.int32()), ("cases", pa.int32()), ("role", pa.string()), ("alias", pa.string()), ("ref", pa.bool_()), ("args", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("table", pa.string()), ("unicode", pa.bool_()), ("beyond", pa.list_(pa.string())), ("outer", pa.int32()), ("within", pa.string()), ("spelt", pa.string())]
SCHEMA = pa.schema([("doc_id", pa.int64()), *FIELDS])
_DDL_TYPE = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
DDL = ", ".join(f"`{f.name}` {_DDL_TYPE[f.type]}" for f in SCHEMA)
_DELIMITED = re.compile(r'^["\[](.*?)["\]]?$', re.S)
_COMPARE = {"<", ">", "=", "!", "*", "+", "-"}


class Unit:
    __slots__ = ("kind", "v", "name", "start", "end", "line", "col", "last_line", "unicode", "text")

    def __init__(self, kind: str, text: str, start: int, end: int, line: int, col: int) -> None:
        self.kind, self.start, self.end, self.line, self.col, self.last_line, self.unicode = kind, start, end, line, col, line, False
        self.text = text
        upper = text.upper()
        self.v = upper
        self.name = upper
        if kind == "Word" and (m := _DELIMITED.match(upper)):
            self.name = m[1]
            self.v = f"[{m[1]}"


def units_of(tokens: Iterable[tuple[str, str, int, int, int, int]]) -> list[Unit]:
    """(kind, text, start, end, line, col) of a script's tokens to units; comments go."""
    out: list[Unit] = []
    dot = False
    for kind, text, start, end, line, col in tokens:
        if kind == "Comment":
            continue
        u = Unit(kind, text, start, end, line, col)
        last = out[-1] if out else None
        if kind == "Punct" and u.v == "." and last and last.kind == "Word":
            dot, last.name = True, last.name + "."
            last.v, last.end = last.name, end
        elif kind == "Word" and dot:
            last.name += u.name
            last.v, last.end, dot = last.name, end, False
        elif kind == "Punct" and last and last.end == start and last.kind == "Punct" and last.v + u.v in ("<=", ">=", "<>", "!=", "!<", "!>", "*=", "=*", "+=", "-="):
            last.v = last.name = last.v + u.v
            last.end = end
        elif kind == "String" and last and last.v == "N" and last.end == start:
            last.kind, last.v, last.name, last.end, last.unicode = "String", u.v, u.v, end, True
        elif kind == "Word" and last and last.v == "@" and last.end == start and u.v.startswith("@"):
            last.kind, last.v, last.name, last.end = "Word", "@" + u.v, "@" + u.v, end
        else:
            dot = False
            out.append(u)
    return out


class _Frame:
    """What a bracket opens, or the script itself."""

    __slots__ = ("open", "fn", "item", "place", "block", "verb", "clause", "cond", "joined", "table", "owner", "source", "beyond", "outer", "within")

    def __init__(self, open_: int, fn: str, outer: _Frame | None, beyond: list[str] | None = None) -> None:
        self.beyond, self.outer, self.within = (beyond, outer.block, outer.clause) if outer else (None, -1, "")
        self.open, self.fn, self.item, self.place, self.joined, self.table, self.owner, self.source = open_, fn, 0, -1, False, "", False, ""
        self.block, self.verb, self.clause, self.cond = (outer.block, outer.verb, outer.clause, outer.cond) if outer else (-1, "", "", 0)


def _is_go(us: list[Unit], i: int) -> bool:
    if us[i].v != "GO" or (i and us[i - 1].line == us[i].line):
        return False
    return i + 1 == len(us) or us[i + 1].line != us[i].line or us[i + 1].kind == "Number"


def _starts(v: str, prev: str, following: str, third: str, head: str, verb: str, header: bool, cases: int, done: bool) -> bool:
    """Whether the word begins a statement, as it stands outside of brackets."""
    if header and v not in ("GO",):
        return False
    if head in ("GRANT", "DENY", "REVOKE") and not done:
        return False
    if v == "SELECT":
        return not (prev in ("UNION", "EXCEPT", "INTERSECT", "ALL", "FOR") or ((head == "INSERT" or head == "WITH" and verb == "INSERT") and not done) or (head == "WITH" and not verb))
    if v in ("INSERT", "UPDATE", "DELETE", "MERGE"):
        if head == "WITH" and not verb:
            return False
        if following == "(" and v == "UPDATE" or v == "MERGE" and following == "JOIN":
            return False
        return not (prev in ("THEN", "OF") or prev == "ON" and head != "SET" or prev == "FOR" and head == "DECLARE")
    if v == "SET":
        return not (head in ("UPDATE", "WITH", "MERGE") and verb in ("UPDATE", "MERGE") and not done or prev in ("DELETE", "UPDATE") or head.startswith("ALTER "))
    if v in ("EXEC", "EXECUTE"):
        return not (prev in ("WITH", ",") or head == "INSERT" and not done)
    if v in ("ALTER", "DROP", "CREATE"):
        return not (prev == "OR" or head.startswith("ALTER ") and following in ("COLUMN", "CONSTRAINT", "MEMBER"))
    if v in ("END", "ELSE"):
        return not cases
    if v == "IF":
        return not (following == "EXISTS" and head.startswith(("DROP", "ALTER")) and third != "(")
    if v == "FETCH":
        return prev not in ("ROWS", "ROW")
    if v == "OPEN":
        return prev != ","
    return v in STARTS and not (v == "USE" and prev == "(")


def scoped(us: list[Unit]) -> list[list]:
    """A row of FIELDS for each unit."""
    n = len(us)
    close = [-1] * n
    stack: list[int] = []
    for i, u in enumerate(us):
        if u.v == "(" and u.kind == "Punct":
            stack.append(i)
        elif u.v == ")" and u.kind == "Punct" and stack:
            close[stack.pop()] = i
    values = [""] * BACK + [u.v for u in us] + [""] * AHEAD
    at = lambda i: us[i].v if 0 <= i < n else ""
    frames = [_Frame(-1, "", None)]
    batch = stmt = cases = 0
    module, head, verb, header, done, boundary = "", "", "", False, False, True
    rows: list[list] = []
    ddl_table = ""
    for i, u in enumerate(us):
        v, prev, following = u.v if u.kind != "String" else "'", at(i - 1), at(i + 1)
        f = frames[-1]
        first = False
        if u.kind == "Punct" and v == ")" and len(frames) > 1:
            frames.pop()
            f = frames[-1]
        elif len(frames) == 1 and (_is_go(us, i) or v == ";"):
            first, boundary = v != ";", True
            stmt += 1
            if v != ";":
                batch, module = batch + 1, ""
            head, verb, header, done, cases = "", "", False, False, 0
            frames[0] = f = _Frame(-1, "", None)
        elif len(frames) == 1:
            cte = v == "WITH" and i + 3 < n and us[i + 1].kind == "Word" and (at(i + 2) == "AS" and at(i + 3) == "(" or at(i + 2) == "(" and close[i + 2] > 0 and at(close[i + 2] + 1) == "AS" and at(close[i + 2] + 2) == "(") and at(i + 1) not in _NOT_ALIAS
            if boundary or cte or u.kind == "Word" and _starts(v, prev, following, at(i + 2), head, verb, header, cases, done):
                if not boundary:
                    stmt += 1
                boundary, first, done, verb = False, True, False, ""
                frames[0] = f = _Frame(-1, "", None)
                head = "WITH" if cte else v
                if v in ("CREATE", "ALTER", "DROP", "UPDATE", "DBCC", "BEGIN", "EXECUTE", "EXEC"):
                    j = i + 1
                    if at(j) == "OR" and at(j + 1) == "ALTER":
                        j += 2
                    while at(j) in ("UNIQUE", "CLUSTERED", "NONCLUSTERED", "SERVER", "DISTRIBUTED"):
                        j += 1
                    if v not in ("UPDATE", "EXEC", "EXECUTE") or at(j) in ("STATISTICS", "AS"):
                        head = f"{v} {_MODULES.get(at(j), at(j))}"
                    if v in ("CREATE", "ALTER") and at(j) in _MODULES:
                        module, header = _MODULES[at(j)], True
                    ddl_table = us[j + 1].name if at(j) == "TABLE" and j + 1 < n else ""
        if header and v == "AS" and prev not in ("EXEC", "EXECUTE") and len(frames) == 1 and not (us[i - 1].kind == "Word" and prev.startswith("@") and i > 1 and at(i - 2) in (",", "(")):
            header, boundary = False, True
        is_open = u.kind == "Punct" and v == "("
        word = u.kind == "Word" and not v.startswith("[") and "." not in v
        if word:
            if v == "CASE":
                cases += 1
            elif v == "END" and cases and not first:
                cases -= 1
            opens_block = v in ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE") and (first or v == "SELECT" or head == "WITH" and not verb and len(frames) == 1) and not header and head not in ("GRANT", "DENY", "REVOKE", "UPDATE STATISTICS")
            if opens_block:
                f.block, f.verb, f.clause, f.cond, f.joined, f.owner, f.item, f.place, f.source = i, v, v, 0, False, True, 0, -1, ""
                if len(frames) == 1:
                    if v == "SELECT" or v != "INSERT":
                        done = done or head in ("INSERT", "WITH") and v == "SELECT"
                    verb = verb or v
            elif f.verb and f.owner:
                if v in ("FROM", "WHERE", "HAVING", "GROUP", "ORDER", "SET", "VALUES", "INTO", "USING", "OUTPUT", "OPTION") and not (v == "ORDER" and following != "BY"):
                    f.clause, f.cond, f.item, f.place = v, i if v in ("WHERE", "HAVING") else 0, 0, -1
                    done = done or len(frames) == 1 and v in ("SET", "VALUES")
                elif v == "ON" and f.joined:
                    f.clause, f.cond = "ON", i
                elif v in ("JOIN", "APPLY") or v in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER") and f.clause in ("FROM", "ON", "USING") and following != "(":
                    f.clause, f.cond, f.joined = "FROM", 0, f.joined or v == "JOIN"
                elif v == "WHEN" and f.verb == "MERGE" and not cases:
                    f.clause, f.cond = "WHEN", 0
                elif v == "FOR" and following in ("XML", "JSON", "BROWSE"):
                    f.clause, f.cond = "FOR", 0
                if v == "USING":
                    f.joined = True
            if v in ("TO", "FROM") and head in ("GRANT", "DENY", "REVOKE"):
                done = True
        if not is_open and v == "," and f.clause == "ON" and f.owner:
            f.clause, f.cond = "FROM", 0
        role = alias = None
        if u.kind == "Word" and f.owner and (u.name == v or v.startswith("[") or "." in v) and v not in RESERVED:
            after_top = prev == ")" and f.clause in ("UPDATE", "DELETE") or i > 0 and us[i - 1].kind == "Number" and f.clause in ("UPDATE", "DELETE")
            if f.clause == "FROM" and prev in ("FROM", "JOIN", "APPLY", ","):
                role = "SOURCE"
            elif f.clause in ("UPDATE", "DELETE", "MERGE", "INSERT", "INTO") and (prev in ("UPDATE", "DELETE", "MERGE", "INSERT", "INTO") or after_top) and not (f.clause == "INTO" and f.verb not in ("INSERT", "SELECT", "MERGE")):
                role = "TARGET"
            elif f.clause == "USING" and prev == "USING":
                role = "SOURCE"
            if f.verb == "DELETE" and f.clause == "FROM" and role and at(f.block + 1) in ("FROM", "TOP") and f.item == 0 and prev == "FROM" and f.source == "":
                role = "TARGET"
            if role:
                f.source = "SYS" if set(u.name.split(".")[:-1]) & _SYSTEM else "USER"
        args, after = None, None
        if is_open or u.kind == "Word" and following == "(" and close[i + 1] > 0:
            o = i if is_open else i + 1
            e = close[o] if close[o] > 0 else n
            if not is_open:
                args, after = _args(us, o, e, close), [at(e + 1), at(e + 2), at(e + 3)]
        if role:
            j = i + 1
            if args is not None and role == "SOURCE":
                j = close[i + 1] + 1
            if at(j) == "AS":
                j += 1
            a = us[j] if j < n else None
            alias = a.name if a and a.kind == "Word" and a.v not in _NOT_ALIAS and "." not in a.v else u.name.split(".")[-1]
        elif v == "ROW_NUMBER" and at(i + 1) == "(" and at(i + 3) == "OVER" and at(i + 4) == "(":
            e = close[i + 4]
            alias = us[i - 2].name if prev == "=" and i > 1 and us[i - 2].kind == "Word" else us[e + 2].name if at(e + 1) == "AS" and e + 2 < n else us[e + 1].name if e + 1 < n and us[e + 1].kind == "Word" and at(e + 1) not in _NOT_ALIAS else None
        if not is_open:
            f.place += 1
        ref = u.kind == "Word" and not v.startswith("@") and args is None and role is None and (v not in RESERVED) and not (len(v) and v[0] == "#" and "." not in v)
        rows.append([i, u.kind, u.v, u.name, u.start, u.line, u.col, values[i : i + BACK + 1 + AHEAD], batch, module, stmt, head, first, len(frames) - 1, f.open, f.fn, f.item, f.place, f.block, f.owner, f.verb, f.clause, f.cond, cases, role, alias, ref, args, after, None, f.table or None, u.unicode, f.beyond, f.outer, f.within, us[i - 1].text if i and f.table else None])
        if not is_open and v == "," and u.kind == "Punct":
            f.item, f.place = f.item + 1, -1
        if word and v == "ADD" and head == "ALTER TABLE" and len(frames) == 1:
            f.table, f.item, f.place = ddl_table or "?", f.item + 1, -1
        if is_open:
            fn = us[i - 1].name if i and us[i - 1].kind == "Word" else ""
            if prev == "AS" and head == "WITH" and not verb and len(frames) == 1:
                k = i - 2
                if at(k) == ")":
                    k = max((x for x in range(k) if close[x] == k), default=0) - 1
                fn = f"CTE {us[k].name}"
            g = _Frame(i, fn, f, [at(close[i] + 1), at(close[i] + 2)] if close[i] > 0 else None)
            f.place += 1
            if head == "CREATE TABLE" and len(frames) == 1 and prev != "AS" and us[i - 1].name == ddl_table:
                g.table = ddl_table
            elif prev == "TABLE" and i > 1 and (us[i - 2].v.startswith("@") or at(i - 2) == "AS" and at(i - 3).startswith("@")):
                g.table = us[i - 2].v if us[i - 2].v.startswith("@") else at(i - 3)
            frames.append(g)
    _item_words(rows)
    _within_batches(rows)
    return rows


def _within_batches(rows: list[list]) -> None:
    """Neighbours of another batch are none: a separator ends what stands before it."""
    names = [f for f, _ in FIELDS]
    batch, w = names.index("batch"), names.index("w")
    starts = [i for i in range(1, len(rows)) if rows[i][batch] != rows[i - 1][batch]]
    for at in starts:
        for i in range(max(0, at - AHEAD), at):
            keep = BACK + at - i
            rows[i][w] = rows[i][w][:keep] + [""] * (BACK + 1 + AHEAD - keep)
        for i in range(at, min(len(rows), at + BACK)):
            gone = BACK - (i - at)
            rows[i][w] = [""] * gone + rows[i][w][gone:]


def _args(us: list[Unit], o: int, e: int, close: list[int]) -> list[str]:
    """The first unit of each argument, its kind before it: c column, v variable, s string, n number, f call, q query, o other."""
    out, j, begin = [], o + 1, True
    while j < e:
        u = us[j]
        if begin:
            if u.kind == "String":
                shape = "s"
            elif u.kind == "Number" or u.v == "-" and j + 1 < e and us[j + 1].kind == "Number":
                shape = "n"
            elif u.kind == "Word":
                shape = "v" if u.v.startswith("@") else "f" if j + 1 < e and us[j + 1].v == "(" else "q" if u.v in ("SELECT", "WITH") else "o" if u.v in RESERVED else "c"
            else:
                shape = "o"
            out.append(shape + u.name)
            begin = False
        if u.v == "(" and u.kind == "Punct" and close[j] > 0:
            j = close[j]
        elif u.v == "," and u.kind == "Punct":
            begin = True
        j += 1
    return out


def _item_words(rows: list[list]) -> None:
    """Gives the first unit of each item of a table's definition all words of the item."""
    names = [f for f, _ in FIELDS]
    table, item, place, open_, depth, words = (names.index(x) for x in ("table", "item", "place", "open", "depth", "words"))
    current = None
    for r in rows:
        if r[table]:
            key = (r[open_], r[item], r[10])
            if current is None or current[0] != key:
                current = (key, r[depth])
                r[words] = own = []
        elif current is not None and (r[depth] <= current[1]):
            current = None
        if current is not None and r[1] == "Word":
            own.append(r[2])


#: Fields that are numbers of units, which a batch's place in its script makes the script's.
_NUMBERS = [[f for f, _ in FIELDS].index(x) for x in ("n", "stmt", "open", "block", "outer")]
_BATCH, _START, _LINE, _COL = ([f for f, _ in FIELDS].index(x) for x in ("batch", "start", "line", "col"))


def _placed(rows: list[list], batch: int, start: int, line: int, col: int) -> list[list]:
    """Units of a batch with their places in the script; numbers of units and statements grow with the bytes before them."""
    for r in rows:
        for i in _NUMBERS:
            if r[i] is not None and r[i] >= 0:
                r[i] += start
        if r[_LINE] == 1:
            r[_COL] += col - 1
        r[_START] += start
        r[_LINE] += line - 1
        r[_BATCH] = batch
    return rows


#: Bytes of a script up to which one task scopes it whole.
WHOLE = 1 << 18


def scopes(scripts: DataFrame) -> DataFrame:
    """Units with their scopes for each row of ``scripts`` (doc_id, sql); a null script has none.

    A script is cut at its separators first, and its batches are dealt to
    tasks, so that a script of many megabytes is scoped by many.
    """
    return spread(cut(scripts), "doc_id", "batch").mapInArrow(_scan, DDL)


def side_by_side(units: DataFrame) -> DataFrame:
    """Units with those of a script together in one task, in their order."""
    return units.repartition("doc_id").sortWithinPartitions("doc_id", "n")


def together(scripts: DataFrame) -> DataFrame:
    """The units of ``scopes``, side by side: scripts are dealt whole, and only those longer than WHOLE by batches, whose units are brought together."""
    scripts = scripts.selectExpr("cast(doc_id as long) as doc_id", "sql")
    longest = F.max(F.coalesce(F.octet_length("sql"), F.lit(0))).over(Window.partitionBy("doc_id"))
    known = evenly(scripts, "doc_id").withColumn("longest", longest)
    whole = cut(known.where(F.col("longest") <= WHOLE)).mapInArrow(_scan, DDL)
    return whole.union(side_by_side(scopes(known.where(F.col("longest") > WHOLE))))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: list[list] = []
        for doc, *place, sql in zip(*[b.column(c).to_pylist() for c in ("doc_id", "batch", "start", "line", "col", "sql")], strict=True):
            tokens = ((k, t.decode("utf-8", "ignore"), *rest) for k, t, *rest in tokenize(sql or b""))
            found += [[doc, *r] for r in _placed(scoped(units_of(tokens)), *place)]
            if len(found) > 20_000:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)


def scopes_of_tokens(tokens: DataFrame) -> DataFrame:
    """The same from rows of ``tsql.tokens``; a script is one group."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        doc = t.column("doc_id")[0].as_py()
        rows = scoped(units_of(zip(*(t.column(c).to_pylist() for c in ("kind", "text", "start", "end", "line", "col")), strict=True)))
        return pa.Table.from_batches([_batch([[doc, *r] for r in rows])] if rows else [], SCHEMA)

    return tokens.groupBy("doc_id").applyInArrow(one, DDL)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
