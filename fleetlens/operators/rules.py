"""Rules over scripts: each is a filter on a unit, its neighbours and what its scope holds.

``functions.scopes`` gives the units with their brackets, statements, query
blocks and clauses. Folds over the script add what a block, a statement, a
batch or the whole script holds, and what it declares. Keywords in brackets or quotes are names and don't count. A
script without units has no findings.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import scopes as sc
from fleetlens.functions.folds import Fact, fold
from fleetlens.functions.spread import evenly

_DML = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
_COMPARE = ("=", "<", ">", "<=", ">=", "<>", "!=")
_TRAN = ("TRAN", "TRANSACTION")
#: Functions that hide the column they are given from an index, and those that do so in a join.
_HIDING = ("UPPER", "LOWER", "LTRIM", "RTRIM", "TRIM", "SUBSTRING", "LEFT", "RIGHT", "CONVERT", "CAST", "ISNULL", "COALESCE", "DATEPART", "DATEDIFF", "YEAR", "MONTH", "DAY", "FORMAT", "REPLACE")
_HIDING_JOINS = (*_HIDING, "CONCAT", "STR")
_SECOND = ("CONVERT", "TRY_CONVERT", "DATEPART", "DATENAME")
#: Methods of typed columns, called with a dot as schema functions are.
_METHODS = ("VALUE", "QUERY", "EXIST", "NODES", "MODIFY", "GETLEVEL", "GETANCESTOR", "GETDESCENDANT", "ISDESCENDANTOF", "TOSTRING", "STASTEXT", "STDISTANCE", "STINTERSECTS", "STAREA", "STLENGTH", "STBUFFER", "STCONTAINS", "STWITHIN", "STX", "STY", "WRITE", "PARSE", "READ")
_NOW = ("GETDATE", "SYSDATETIME", "SYSUTCDATETIME", "GETUTCDATE", "CURRENT_TIMESTAMP", "SYSDATETIMEOFFSET")
_AGGREGATES = ("SUM", "COUNT", "COUNT_BIG", "AVG", "MIN", "MAX")
_STRINGS = ("CHAR", "VARCHAR", "NCHAR", "NVARCHAR", "BINARY", "VARBINARY")
_LOB = ("TEXT", "NTEXT", "IMAGE")
#: Built-in functions and clauses by the year of the server that brought them.
_SINCE = {
    2012: ("CONCAT", "IIF", "FORMAT", "EOMONTH", "TRY_CAST", "TRY_CONVERT", "DATEFROMPARTS"),
    2016: ("STRING_SPLIT", "OPENJSON", "JSON_VALUE", "JSON_QUERY", "ISJSON", "STRING_ESCAPE", "DATEDIFF_BIG"),
    2017: ("STRING_AGG", "TRIM", "CONCAT_WS", "TRANSLATE"),
    2019: ("APPROX_COUNT_DISTINCT",),
    2022: ("GREATEST", "LEAST", "DATETRUNC", "DATE_BUCKET", "GENERATE_SERIES", "JSON_OBJECT", "JSON_ARRAY", "APPROX_PERCENTILE_CONT", "APPROX_PERCENTILE_DISC", "BIT_COUNT", "LEFT_SHIFT", "RIGHT_SHIFT"),
    2025: ("REGEXP_LIKE", "REGEXP_REPLACE", "REGEXP_SUBSTR", "JSON_OBJECTAGG", "JSON_ARRAYAGG", "VECTOR_DISTANCE"),
}
#: Built-in roles by how much they give away.
_ROLES = {"critical": ("SYSADMIN",), "error": ("SECURITYADMIN", "SERVERADMIN", "DB_OWNER", "DB_SECURITYADMIN", "DB_ACCESSADMIN"), "warning": ("DB_DDLADMIN",)}
#: Last words of a column's name that say money; words that make a cost money, and those that make it a plan's.
_MONEY = ("amount", "amt", "price", "salary", "wage", "revenue", "payment", "subtotal", "discount")
_TRADE = ("unit", "item", "product", "purchase", "shipping", "standard", "labor", "labour", "material", "goods", "sales", "order", "freight", "landed", "acquisition", "replacement", "total", "avg", "average", "net", "gross", "actual", "estimated", "budget", "budgeted", "list", "invoice", "billed", "billing")
_PLAN = ("plan", "query", "spool", "sort", "lookup", "subtree", "operator", "cpu", "io", "statement", "estimate", "node", "compile", "optimizer", "optimiser", "seek", "scan")
#: How names of catalog columns end.
_METADATA = r"(NAME|TABLE|SCHEMA|DATABASE|DB|COLUMN|INDEX|OBJECT|VIEW|PROC|PROCEDURE|FUNCTION|TRIGGER|USER|LOGIN|ROLE|TYPE|SERVER|ID|_ON)$"


#: The text of a unit that may be a name.
_NAME = r"^[^0-9'@(),;.*+=<>!%&|^~/-]"


def _v(i: int) -> Column:
    """The unit ``i`` places on, in upper case; '' beyond the script."""
    return F.expr(f"get(w, {sc.BACK + i})")


def _is(c: Column, *words: str) -> Column:
    return F.coalesce(c.isin(*words), F.lit(False))


def _words(name: Column) -> Column:
    """The words of a name in lower case, cut at ``_``, blanks, ``$`` and where capitals say so: unitPrice, HTTPServer."""
    apart = F.regexp_replace(F.btrim(name, F.lit('[]"')), "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(F.regexp_replace(apart, "([A-Z])([A-Z][a-z])", "$1_$2")), "[_ $]+"), lambda w: w != "")


def _among(i: int, words: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"coalesce(get(w, {sc.BACK + i}) in ({quoted}), false)"


def _at(i: int, *words: str) -> Column:
    # one parsed expression: building these call by call takes longer than running them
    return F.expr(_among(i, words))


def _seq(*words: str | tuple[str, ...], start: int = 0) -> Column:
    """Units from ``start`` on are these words; a tuple lists alternatives."""
    return F.expr(" and ".join(_among(start + i, (w,) if isinstance(w, str) else w) for i, w in enumerate(words)))


def _like(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _any(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _has(hit: Column, *keys: str) -> Fact:
    return Fact("has", hit, keys)


def _count(hit: Column, *keys: str) -> Fact:
    return Fact("count", hit, keys)


class _Nth(NamedTuple):
    """The first ``most`` units of a script, by ``key``, where ``hit`` holds, as far as ``also`` holds there."""

    hit: Column
    key: Column
    most: int = 1
    also: Column | None = None

    def __and__(self, other: Column) -> _Nth:
        return self._replace(also=other if self.also is None else self.also & other)


def _first(hit: Column, *keys: str) -> _Nth:
    return _Nth(hit, F.concat_ws(",", *keys) if keys else F.lit(""))


def _last_part(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def _is_temp(c: Column) -> Column:
    return F.coalesce(_last_part(c).rlike("^[@#]"), F.lit(False))


def _is_system(c: Column) -> Column:
    return _like(c, r"^(.*\.)?(SYS|INFORMATION_SCHEMA)\.[^.]*$|^(MSDB|MASTER|MODEL|TEMPDB)\.")


def _arg(i: int, shape: str) -> Column:
    return F.coalesce(F.get("args", F.lit(i)).startswith(shape), F.lit(False))


def _n_args() -> Column:
    return F.coalesce(F.size("args"), F.lit(-1))


def _word() -> Column:
    return F.col("kind") == "Word"


def _call() -> Column:
    return F.col("args").isNotNull() & _word()


def _string() -> Column:
    return F.col("kind") == "String"


def _number() -> Column:
    return F.col("kind") == "Number"


def _own() -> Column:
    return F.col("own") & (F.col("block") >= 0)


def _source() -> Column:
    return F.coalesce(F.col("role") == "SOURCE", F.lit(False))


def _target() -> Column:
    return F.coalesce(F.col("role") == "TARGET", F.lit(False))


def _user() -> Column:
    return _source() & F.col("args").isNull() & ~_is_temp(F.col("name")) & ~_is_system(F.col("name"))


def _cond() -> Column:
    return F.col("cond") > 0


def _last() -> Column:
    return _last_part(F.col("name"))


def _typed() -> Column:
    return F.col("table").isNotNull() & (F.col("place") == 1)


def _defined() -> Column:
    return F.col("words").isNotNull() & _word() & ~_at(0, "CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "INDEX", "PERIOD", "CLUSTERED", "ADD")


def select_own() -> Column:
    return _own() & (F.col("clause") == "SELECT")


def _predicate() -> Column:
    """A column of WHERE that stands alone before a comparison with a value."""
    value = _like(_v(2), r"^([0-9@'(-]|CAST|CONVERT|N$)") | (_at(1, "BETWEEN") & _like(_v(2), r"^[0-9@'(-]")) | _at(2, "DATEADD", *_NOW)
    return _own() & F.col("ref") & (F.col("clause") == "WHERE") & (F.col("cases") == 0) & _at(-1, "WHERE", "AND") & _at(1, "=", "<", ">", "<=", ">=", "BETWEEN", "IN") & value & ~_at(3, "+", "-", "*", "/", "%")


def _in_scope() -> dict[str, Fact]:
    """What a unit's block, statement, batch and script hold."""
    joins = _own() & _at(0, "JOIN")
    outer = joins & (_at(-1, "LEFT", "RIGHT", "FULL", "CROSS", "OUTER"))
    return {
        "b_where": _has(_own() & _at(0, "WHERE"), "block"),
        "b_from": _has(_own() & _at(0, "FROM"), "block"),
        "b_order": _has(_own() & _seq("ORDER", "BY"), "block"),
        "b_group": _has(_own() & _seq("GROUP", "BY"), "block"),
        "b_top": _has(_own() & _at(0, "TOP") & _is(F.col("clause"), *_DML), "block"),
        "b_offset": _has(_own() & _at(0, "OFFSET"), "block"),
        "b_distinct": _has(_own() & _at(0, "DISTINCT") & _at(-1, "SELECT"), "block"),
        "b_join": _has(joins, "block"),
        "b_restricts": _has(joins & ~outer, "block"),
        "b_apply": _has(_own() & _at(0, "APPLY"), "block"),
        "b_hinted": _has(_own() & _seq("WITH", "(") & (F.col("clause") == "FROM"), "block"),
        "b_xml": _has(_own() & _seq("FOR", ("XML", "JSON")), "block"),
        "b_shaped": _has(_own() & _like(F.col("name"), r"[/@(]") & _like(F.col("v"), r"^\["), "block"),
        "b_sources": _count(_own() & _source(), "block"),
        "b_user": _has(_own() & _user(), "block"),
        "b_system": _has(_own() & _source() & _is_system(F.col("name")), "block"),
        "b_function": _has(_own() & _source() & F.col("args").isNotNull(), "block"),
        "b_temp": _has(_own() & (_source() | _target()) & _is_temp(F.col("name")), "block"),
        "b_into": _has(_own() & _at(0, "INTO"), "block"),
        "b_derived": _has(_own() & _at(0, "(") & _is(F.col("clause"), "FROM", "USING") & _at(-1, "FROM", "JOIN", ",", "APPLY", "USING"), "block"),
        "b_commas": _count(_own() & _at(0, ",") & (F.col("clause") == "FROM"), "block"),
        "b_last_item": Fact("max", F.when(_own() & (F.col("clause") == "SELECT"), F.col("item")), ("block",)),
        "b_aggregate": _has(_call() & _own() & (F.col("clause") == "SELECT") & _is(F.col("name"), *_AGGREGATES) & ~_is(F.get("after", F.lit(0)), "OVER"), "block"),
        "b_over": _has(_own() & _at(0, "OVER"), "block"),
        "b_assigns": _has(_own() & (F.col("clause") == "SELECT") & _like(F.col("v"), "^@") & _at(1, "=", "+=") & (F.col("place") <= 1), "block"),
        "b_and": _count(_own() & _at(0, "AND", "OR") & (F.col("clause") == "WHERE"), "block"),
        "b_target": Fact("max", F.when(_own() & _target(), F.col("name")), ("block",)),
        "b_percent": _has(_own() & _at(0, "PERCENT"), "block"),
        "b_top_one": _has(_own() & ((_at(0, "TOP") & _at(1, "1")) | _seq("TOP", "(", "1", ")")), "block"),
        "b_joins": _count(joins & ~_at(-1, "CROSS"), "block"),
        "b_ons": _count(_own() & _at(0, "ON"), "block"),
        "b_ors": _count(_at(0, "OR") & _is(F.col("clause"), "WHERE"), "block"),
        "b_keyed": _has(_own() & F.col("ref") & (F.col("clause") == "WHERE") & _at(1, "=") & (_like(_v(2), r"^([0-9@']|-)")) & _like(_last(), "(ID|KEY|GUID|CODE|NO|NUM|NUMBER)$"), "block"),
        "b_counts": _has(F.col("ref") & _own() & (F.col("clause") == "SELECT") & _at(1, "+") & _like(_v(2), "^[0-9]+$"), "block"),
        "b_left": Fact("collect_set", F.when(_own() & _source() & _at(-1, "JOIN") & (_at(-2, "LEFT", "FULL") | (_at(-2, "OUTER") & _at(-3, "LEFT", "FULL"))), F.col("alias")), ("block",)),
        "b_right_at": Fact("max", F.when(_own() & _source() & _at(-1, "JOIN") & (_at(-2, "RIGHT") | (_at(-2, "OUTER") & _at(-3, "RIGHT"))), F.col("n")), ("block",)),
        "b_separated": _has(select_own() & _string() & _at(1, "+"), "block"),
        "b_tables": Fact("collect_set", F.when(_own() & (_source() | _target()), F.coalesce(_last_part(F.col("name")), F.lit(""))), ("block",)),
        "b_source": Fact("max", F.when(_own() & _source(), F.col("name")), ("block",)),
        "b_eq": Fact("collect_set", F.when(_predicate() & _at(1, "=", "IN"), _last()), ("block",)),
        "b_range": Fact("collect_set", F.when(_predicate() & _at(1, "<", ">", "<=", ">=", "BETWEEN"), _last()), ("block",)),
        "b_good": _count(_predicate(), "block"),
        "b_betweens": _count(_own() & (F.col("clause") == "WHERE") & _at(0, "BETWEEN"), "block"),
        "b_ordered": Fact("collect_set", F.when(_own() & F.col("ref") & (F.col("clause") == "ORDER") & _at(-1, "BY", ","), _last()), ("block",)),
        "b_projected": Fact("collect_set", F.when(select_own() & F.col("ref") & ~_at(-1, "AS"), _last()), ("block",)),
        "b_qualifiers": Fact("collect_set", F.when(F.col("ref") & _like(F.col("name"), r"\."), F.element_at(F.split("name", r"\."), 1)), ("block",)),
        "b_equijoins": _count(_own() & F.col("ref") & (F.col("clause") == "ON") & _at(1, "=") & _like(_v(2), _NAME) & _like(_v(2), r"\.") & _at(-1, "ON"), "block"),
        "b_on_ands": _count(_own() & (F.col("clause") == "ON") & _at(0, "AND", "OR"), "block"),
        "b_inner": _has(_own() & _at(0, "JOIN") & ~_at(-1, "LEFT", "RIGHT", "FULL", "CROSS", "OUTER"), "block"),
        "b_names": Fact("collect_set", F.when(_own() & (_source() | _target()), F.col("alias")), ("block",)),
        "b_temp_aliases": Fact("collect_set", F.when(_own() & _source() & _is_temp(F.col("name")), F.col("alias")), ("block",)),
        "b_aliases": Fact("collect_set", F.when(_own() & _source(), F.col("alias")), ("block",)),
        "b_own_sources": Fact("collect_list", F.when(_own() & _source(), F.struct("n", "alias")), ("block",)),
        "s_parameter": _has(F.col("ref") & _cond() & _at(1, "=") & _like(_v(2), "^@") | (_cond() & _like(_v(0), "^@") & _at(1, "=") & _like(_v(2), _NAME)), "stmt"),
        "s_everywhere": _has(_seq("-", "1"), "stmt"),
        "s_escalation": _has(_at(0, "1211", "1224"), "stmt"),
        "s_ranged": Fact("collect_set", F.when(F.col("ref") & _cond() & _at(1, ">", ">=", "BETWEEN"), _last()), ("stmt",)),
        "f_styled": _has(F.col("item") >= 2, "open"),
        "f_sources": Fact("collect_list", F.when(_source() & _own(), F.col("name")), ("stmt", "open",)),
        "f_union": _has(_at(0, "UNION") & _own(), "stmt", "open"),
        "f_unreal": _has(_source() & _own() & ~_user(), "stmt", "open"),
        "n_table": _has(_seq("RETURNS", "TABLE") | (_at(0, "RETURNS") & _like(_v(1), "^@")), "batch"),
        "s_words": Fact("collect_set", F.when(_word(), F.col("v")), ("stmt",)),
        "s_ctes": Fact("collect_set", F.when(F.col("fn").startswith("CTE "), F.substring("fn", 5, 999)), ("stmt",)),
        "s_filtered_ctes": Fact("collect_set", F.when(F.col("fn").startswith("CTE ") & _own() & _at(0, "WHERE"), F.substring("fn", 5, 999)), ("stmt",)),
        "s_user": _has(_user(), "stmt"),
        "s_ctes_read": Fact("collect_set", F.when(F.col("fn").startswith("CTE ") & _source(), F.concat(F.col("fn"), F.lit(">"), F.col("name"))), ("stmt",)),
        "g_ors": _count(_cond() & _at(0, "OR") & (F.col("cases") == 0), "cond", "open"),
        "f_plus": _has(_at(0, "+"), "open"),
        "f_var": _has(_like(F.col("v"), "^@"), "open"),
        "f_partition": _has(_at(0, "PARTITION"), "open"),
        "n_nocount": _has(F.col("first") & _at(0, "SET") & (_at(1, "NOCOUNT") | _at(2, "NOCOUNT") | _at(3, "NOCOUNT")), "batch"),
        "n_external": _has(_seq("EXTERNAL", "NAME"), "batch"),
        "n_begins": _has(_begins_tran(), "batch"),
        "n_xact": _has(F.col("first") & _at(0, "SET") & (_at(1, "XACT_ABORT") | _at(3, "XACT_ABORT")), "batch"),
        "n_guard": _has(_at(0, "@@TRANCOUNT") | _at(0, "XACT_STATE"), "batch"),
        "n_changes": _count(F.col("first") & _is(F.col("head"), "INSERT", "UPDATE", "DELETE", "MERGE") & ~_at(1, "@"), "batch"),
        "n_as": _count(_seq(("EXEC", "EXECUTE"), "AS", ("LOGIN", "USER")) & F.col("first"), "batch"),
        "n_reverts": _count(_at(0, "REVERT") & F.col("first"), "batch"),
        "n_rowcount": _has(_seq("SET", "ROWCOUNT") & ~_at(2, "0"), "batch"),
        "n_saved": Fact("collect_set", F.when(_seq("SAVE", _TRAN), _v(2)), ("batch",)),
        "d_recompiles": _count(_recompiles()),
        "d_queries": _count(_word() & _at(0, *_DML)),
        "d_recovery": _has(_seq("ACCELERATED_DATABASE_RECOVERY", "=", "ON")),
        "d_changes_rows": _has(F.col("first") & _is(F.col("head"), "INSERT", "UPDATE", "DELETE", "MERGE")),
        "d_constants": Fact("collect_set", F.when(_assigned("^'"), F.col("v")), ()),
        "d_computed": Fact("collect_set", F.when(_assigned("^[^']") | _assigned("^'", False) | (_like(F.col("v"), "^@") & _at(1, "+=")), F.col("v")), ()),
        "o_before": Fact("latest", F.when(_begins_tran(), F.col("n")), ("batch",)),
        "o_closed": Fact("latest", F.when(_at(0, "COMMIT", "ROLLBACK"), F.col("n")), ("batch",)),
        "d_rolls_back_whole": _has(_at(0, "ROLLBACK") & ~_at(1, *_TRAN)),
        "d_rolled_back_to": Fact("collect_set", F.when(_at(0, "ROLLBACK") & _at(1, *_TRAN), F.concat_ws(":", "batch", _v(2)))),
        "d_saved": Fact("collect_set", F.when(_seq("SAVE", _TRAN), F.concat_ws(":", "batch", _v(2)))),
        "d_commits": _has(_at(0, "COMMIT")),
        "d_rolls_back_to": _has(_at(0, "ROLLBACK")),
        "d_tries": _has(_seq("BEGIN", "TRY")),
    }


def with_facts(t: DataFrame) -> DataFrame:
    """Units with what their scopes hold and their script declares; a script's units stand together in a task."""
    member = lambda names, of: F.coalesce(F.array_contains(names, F.col(of)), F.lit(False))
    index_key = lambda k: F.when(k["indexed"], F.array_contains("d_clustered", k["stmt"])).otherwise(k["clustered"])
    return fold(t, _in_scope() | _declared()).withColumns({
        "b_items": F.coalesce("b_last_item", F.lit(0)) + 1,
        "f_real": ~F.col("f_unreal"),
        "b_alias_temp": member("b_temp_aliases", "b_target"),
        "b_alias": member("b_aliases", "b_target"),
        "b_right": F.transform(F.filter("b_own_sources", lambda s: s["n"] < F.col("b_right_at")), lambda s: s["alias"]),
        "d_rolls_back": F.col("d_rolls_back_whole") | (F.size(F.array_except("d_rolled_back_to", "d_saved")) > 0),
        "keys": F.transform("keys", lambda k: k.withField("clustered", index_key(k))),
    })


#: Bytes of a column by its type.
_WIDTHS = {"TINYINT": 1, "BIT": 1, "SMALLINT": 2, "DATE": 3, "INT": 4, "REAL": 4, "SMALLDATETIME": 4, "BIGINT": 8, "MONEY": 8, "FLOAT": 8, "DATETIME": 8, "DATETIME2": 8, "DECIMAL": 9, "NUMERIC": 9, "DATETIMEOFFSET": 10, "UNIQUEIDENTIFIER": 16, "SYSNAME": 256}


def _plain(c: Column) -> Column:
    """The last part of a name, without the mark of a quoted one."""
    return _last_part(F.ltrim(c, F.lit("[")))


def _declared() -> dict[str, Fact]:
    """What a script declares: columns, keys, included columns, variables, aliases, and the statements that say CLUSTERED."""
    kind = _plain(_v(1))
    size = F.coalesce(F.when(_at(2, "("), _v(3)).try_cast("int"), F.when(_at(2, "(") & _at(3, "MAX"), F.lit(8000)), F.lit(1))
    width = F.when(_is(kind, "CHAR", "VARCHAR", "BINARY", "VARBINARY"), size).when(_is(kind, "NCHAR", "NVARCHAR"), 2 * size)
    for name, n in _WIDTHS.items():
        width = width.when(kind == name, n)
    lob = (_at(2, "(") & _at(3, "MAX")) | _is(kind, "XML", "TEXT", "NTEXT", "IMAGE", "GEOGRAPHY", "GEOMETRY")
    column = F.when(_defined(), F.struct("n", _last_part(F.col("table")).alias("table"), F.col("name").alias("column"), kind.alias("type"), width.alias("width"), lob.alias("lob")))
    names = F.transform(F.filter(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.startswith("c")), lambda a: a.substr(F.lit(2), F.lit(500)))
    table_key = F.col("table").isNotNull() & F.col("args").isNotNull() & (_at(0, "CLUSTERED", "NONCLUSTERED") | (_at(0, "KEY") & _at(-1, "PRIMARY")) | (_at(0, "UNIQUE")))
    own_key = _defined() & F.arrays_overlap("words", F.array(F.lit("PRIMARY"), F.lit("UNIQUE")))
    index = (F.col("head") == "CREATE INDEX") & F.col("args").isNotNull() & _at(-1, "ON")
    no_names = F.array().cast("array<string>")
    key = (
        F.when(index, F.struct("n", "stmt", _last_part(F.col("name")).alias("table"), F.lit(False).alias("clustered"), F.lit(True).alias("indexed"), names.alias("columns")))
        .when(table_key, F.struct("n", "stmt", _last_part(F.col("table")).alias("table"), (_at(0, "CLUSTERED") | _at(0, "KEY")).alias("clustered"), F.lit(False).alias("indexed"), names.alias("columns")))
        .when(own_key, F.struct("n", "stmt", _last_part(F.col("table")).alias("table"), (F.array_contains("words", "PRIMARY") & ~F.array_contains("words", "NONCLUSTERED")).alias("clustered"), F.lit(False).alias("indexed"), F.array("name").alias("columns")))
    )
    included = F.when((F.col("head") == "CREATE INDEX") & _at(0, "INCLUDE"), F.struct("stmt", names.alias("columns")))
    text_type = _plain(F.when(_at(1, "AS"), _v(2)).otherwise(_v(1)))
    variable = F.when(_like(F.col("v"), "^@") & _is(text_type, *_STRINGS), F.struct("v", text_type.alias("type")))
    alias = F.when(F.col("role").isNotNull() & _own(), F.struct("block", "alias"))
    clustered = F.when(_at(0, "CLUSTERED") & (F.col("depth") == 0), F.col("stmt"))
    lists = (("columns", column), ("keys", key), ("included", included), ("variables", variable), ("aliases", alias))
    return {"d_clustered": Fact("collect_set", clustered)} | {n: Fact("collect_list", c) for n, c in lists}


def _declared_rules() -> list[tuple[str, str | Column, Column]]:
    """Rules that hold a unit against what its script declares."""
    column = lambda test: F.exists("columns", test)
    head = lambda k: F.get(k["columns"], F.lit(0))
    guid_name = r"(GUID|UUID|ROWGUID)"
    creates = F.col("first") & (F.col("head") == "CREATE TABLE") & ~_is_temp(F.ltrim(_v(2), F.lit("["))) & _at(3, "(")
    made = _plain(_v(2))
    here = F.get(F.filter("keys", lambda k: k["n"] == F.col("n")), F.lit(0))
    is_key = F.exists("keys", lambda k: k["n"] == F.col("n"))
    lead = F.get(here["columns"], F.lit(0))
    lead_guid = column(lambda c: (c["table"] == here["table"]) & (c["column"] == lead) & (c["type"] == "UNIQUEIDENTIFIER"))
    table_temp = _is_temp(F.coalesce(F.col("table"), F.when(here["indexed"], F.col("name")), F.lit("")))
    width = F.aggregate(F.filter("columns", lambda c: (c["table"] == here["table"]) & F.array_contains(here["columns"], c["column"])), F.lit(0), lambda a, c: a + F.coalesce(c["width"], F.lit(0)))
    undecided = _defined() & (F.col("head") == "CREATE TABLE") & ~_is_temp(F.col("table")) & ~F.arrays_overlap("words", F.array(*map(F.lit, ("NULL", "IDENTITY", "PRIMARY", "ROWGUIDCOL", "AS", "COLUMN_SET")))) & _like(_v(1), r"^[A-Z\[]")
    harmful = lambda c: (c["column"] == _last()) & c["type"].isin("VARCHAR", "CHAR") & F.array_contains("b_tables", c["table"])
    wide_variable = lambda name: F.exists("variables", lambda v: (v["v"] == name) & v["type"].isin("NVARCHAR", "NCHAR"))
    view = (F.col("module") == "VIEW") | ((F.col("module") == "FUNCTION") & F.col("n_table"))
    at_select = _own() & (F.col("block") == F.col("n")) & (F.col("verb") == "SELECT")
    single = at_select & (F.col("b_sources") == 1) & ~F.col("b_join") & ~F.col("b_apply") & ~F.col("b_derived") & F.col("b_user") & ~F.coalesce(F.arrays_overlap("s_ctes", "b_tables"), F.lit(False)) & ~view & (F.col("b_commas") == 0)
    asked = F.array_union("b_eq", "b_range")
    source = _last_part(F.col("b_source"))
    served = F.exists("keys", lambda k: (k["table"] == source) & F.array_contains(asked, head(k)))
    plain_where = F.col("b_where") & (F.col("b_good") == F.col("b_and") - F.col("b_betweens") + 1) & (F.col("b_ors") == 0)
    wanted = F.concat_ws(",", F.lit("x"), source, F.array_sort("b_eq"), F.when(F.size("b_eq") == 0, F.array_sort("b_range")))
    keyed = F.exists("b_eq", lambda c: (c == "ID") | (c == F.concat(source, F.lit("ID"))) | (c == F.concat(F.regexp_replace(source, "S$", ""), F.lit("ID"))))
    missing = single & plain_where & ~served & (F.size(asked) > 0) & ~keyed & ~F.col("f_union") & ~F.col("b_hinted") & ~F.col("b_xml")
    sorts = single & F.col("b_order") & ~F.col("b_group") & ~F.col("b_offset") & ~F.col("b_top_one") & ~F.col("b_distinct") & ~F.col("b_xml") & ~F.col("n_rowcount") & (F.size("b_ordered") > 0) & (F.size(F.array_except("b_ordered", "b_eq")) > 0) & (F.size(F.array_except("b_range", "b_ordered")) == 0)
    ordered_by_key = F.exists("keys", lambda k: (k["table"] == source) & F.array_contains("b_ordered", head(k)))
    covers = lambda k: F.array_union(k["columns"], F.flatten(F.transform(F.filter("included", lambda i: i["stmt"] == k["stmt"]), lambda i: i["columns"])))
    lookups = single & plain_where & (F.size("b_range") == 0) & F.exists("keys", lambda k: k["indexed"] & ~k["clustered"] & (k["table"] == source) & F.array_contains("b_eq", head(k)) & (F.size(F.array_except("b_projected", covers(k))) >= 3))
    joined = at_select & (F.col("b_sources") == 2) & (F.col("b_joins") == 1) & F.col("b_inner") & (F.col("b_equijoins") == 1) & (F.col("b_on_ands") == 0) & ~F.col("b_group") & ~F.col("b_top") & plain_where & (F.size("b_eq") > 0) & ~F.col("b_system") & ~F.col("b_temp") & ~F.col("b_function") & ~view & ~F.coalesce(F.arrays_overlap("s_ctes", "b_tables"), F.lit(False))
    joined_served = F.exists("keys", lambda k: F.array_contains("b_tables", k["table"]) & F.array_contains("b_eq", head(k)))
    outside = F.exists(F.array_except("b_qualifiers", "b_names"), lambda q: F.exists("aliases", lambda a: (a["block"] == F.col("outer")) & (a["alias"] == q)))
    return [
        ("hygiene.heap_table", "warning", creates & ~F.exists("keys", lambda k: (k["table"] == made) & k["clustered"]) & column(lambda c: (c["table"] == made) & ~F.coalesce(c["lob"], F.lit(False)))),
        ("ddl.nullable_columns_should_be_explicit", "info", _Nth(undecided, F.lit(""), 3)),
        ("ddl.fillfactor_default_zero_on_random_inserts", "info", is_key & here["indexed"] & here["clustered"] & ~table_temp & (_like(lead, guid_name) | lead_guid) & ~_word_in_statement("FILLFACTOR")),
        ("index.guid_clustered_key", "warning", is_key & here["clustered"] & ~table_temp & ((here["indexed"] & _like(lead, guid_name)) | (~here["indexed"] & lead_guid))),
        ("index.wide_clustered_key", "warning", is_key & here["clustered"] & ~table_temp & (F.size(here["columns"]) >= 2) & (width > 32)),
        ("sarg.implicit_conversion_param_type", "error", F.col("ref") & _cond() & ((_at(1, *_COMPARE) & wide_variable(_v(2))) | (_at(-1, *_COMPARE) & wide_variable(_v(-2)))) & column(harmful)),
        ("index.missing_index_from_predicate", "info", _Nth(missing, wanted)),
        ("index.order_by_forces_sort", "info", sorts & ~ordered_by_key),
        ("index.key_lookup_risk", "info", lookups),
        ("index.join_filter_missing_index", "info", joined & ~joined_served),
        ("antipattern.correlated_scalar_subquery_in_select", "warning", at_select & (F.col("open") >= 0) & (F.col("within") == "SELECT") & ~_is(F.col("fn"), "EXISTS", "IN", "ANY", "ALL", "SOME") & ~F.col("b_xml") & ~(F.col("b_function") & (F.col("b_sources") == 1)) & outside),
    ]


def _begins_tran() -> Column:
    return _seq("BEGIN", _TRAN) | _seq("BEGIN", "DISTRIBUTED", _TRAN)


def _recompiles() -> Column:
    return _at(0, "OPTION") & F.exists(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.endswith("RECOMPILE"))


def _assigned(value: str, alone: bool = True) -> Column:
    """A variable that a SET or DECLARE gives such a value; alone: nothing is added to it."""
    hit = F.lit(False)
    for i in (1, 2, 5):  # its type may stand between, with a length or without
        ends = _at(i + 2, ";", "", ",") | _at(i + 2, *sc.STARTS)
        hit |= _at(i, "=") & _like(_v(i + 1), value) & (ends if alone else ~ends)
    if value != "^'":
        hit = F.lit(False)
        for i in (1, 2, 5):
            hit |= _at(i, "=") & _like(_v(i + 1), value)
    return _like(F.col("v"), "^@") & _at(-1, "SET", "DECLARE", ",") & hit


def _word_in_statement(*words: str) -> Column:
    return F.arrays_overlap("s_words", F.array(*map(F.lit, words)))


def _rules(target: int | None) -> list[tuple[str, str | Column, Column]]:
    """(rule, severity, when it fires at a unit). Rules that need a newer server are silent without ``target``."""
    since = lambda year: F.lit(target is not None and target >= year)
    known_before = lambda year: F.lit(target is not None and target < year)
    select_item = _own() & (F.col("clause") == "SELECT")
    starred = _at(-1, "SELECT", "DISTINCT", "ALL") | _at(-2, "TOP") | _seq("TOP", "(", start=-4) | (_at(-1, "PERCENT", "TIES"))
    configures = _string() & _at(-1, "SP_CONFIGURE", "SYS.SP_CONFIGURE", "MASTER.SYS.SP_CONFIGURE", "MASTER.DBO.SP_CONFIGURE", "MASTER..SP_CONFIGURE")
    sets = lambda option, value: configures & _at(0, f"'{option}'") & _seq(",", value, start=1)
    database = F.col("head") == "ALTER DATABASE"
    compared = _is(F.get("after", F.lit(0)), *_COMPARE, "IN") | (_is(F.get("after", F.lit(0)), "NOT") & _is(F.get("after", F.lit(1)), "IN")) | _at(-1, *_COMPARE)
    given = F.when(_is(F.col("name"), *_SECOND), _arg(1, "c")).when(F.col("name") == "DATEDIFF", _arg(1, "c") | _arg(2, "c")).otherwise(_arg(0, "c"))
    between = _is(F.get("after", F.lit(0)), "BETWEEN")
    two_part = _call() & _like(F.col("name"), r"^[^.@#]+\.[^.]+$") & ~_is(_last(), *_METHODS) & F.col("role").isNull()
    schema_call = two_part & ~F.array_contains("b_names", F.element_at(F.split("name", r"\."), 1))
    user_block = F.col("b_user") & ~F.col("b_system") & ~F.col("b_function")
    simple = _own() & (F.col("verb") == "SELECT") & (F.col("b_sources") == 1) & ~F.col("b_derived") & ~F.col("b_join") & ~F.col("b_apply") & F.col("b_user")
    cte_source = F.coalesce(F.arrays_overlap("s_ctes", "b_tables"), F.lit(False))
    typed = lambda *names: _typed() & _is(F.col("v"), *names)
    declared = (_at(-1, "AS") & _like(_v(-2), "^@")) | (_like(_v(-1), "^@") & ~_at(-2, "=", "+", ",", "(") | (_like(_v(-1), "^@") & _at(-2, "DECLARE", ",")))
    cast_to = (_at(-1, "AS") & _is(F.col("fn"), "CAST", "TRY_CAST")) | (_is(F.col("fn"), "CONVERT", "TRY_CONVERT") & _at(-1, "("))
    column_name, words = _v(-1), _words(F.col("spelt"))
    one_of = lambda names: F.arrays_overlap(words, F.array(*map(F.lit, names)))
    last_word = F.try_element_at(words, F.lit(-1))
    money = _is(last_word, *_MONEY) | (_is(last_word, "cost") & one_of(_TRADE) & ~one_of(_PLAN))
    privileged = lambda level: _any(*[_like(F.upper(F.concat_ws(" ", F.slice("w", sc.BACK + 1, 9))), rf"(^|[ \['\"]){r}([ \]'\"]|$)") for r in _ROLES[level]])
    adds_member = (_seq("ALTER", "ROLE") & _seq("ADD", "MEMBER", start=3)) | (_seq("ALTER", "SERVER", "ROLE") & _seq("ADD", "MEMBER", start=4)) | _is(_last(), "SP_ADDROLEMEMBER", "SP_ADDSRVROLEMEMBER")
    newer = _any(*[_call() & _is(F.col("v"), *names) & known_before(year) for year, names in _SINCE.items()])
    newer_clause = (_seq("DROP", ("TABLE", "VIEW", "PROCEDURE", "PROC", "FUNCTION", "TRIGGER", "INDEX", "SCHEMA", "TYPE", "SEQUENCE", "USER"), "IF", "EXISTS") & known_before(2016)) | (_seq("DISTINCT", "FROM") & _at(-1, "IS", "NOT") & known_before(2022)) | (_at(0, "WINDOW") & _at(2, "AS") & _at(3, "(") & known_before(2022))
    flag = _at(0, "1211", "1224")
    ddl = F.col("first") & _like(F.col("head"), "^(CREATE|ALTER|DROP|TRUNCATE)( |$)") & ~_like(F.col("head"), "PROCEDURE|FUNCTION|TRIGGER|VIEW")
    temp_ddl = _any(*[_like(_v(i), "^#") for i in (1, 2, 3, 4, 5)])
    in_tran = F.coalesce(F.col("o_before") > F.coalesce(F.col("o_closed"), F.lit(-1)), F.lit(False))
    changes = F.col("first") & _is(F.col("head"), "UPDATE", "DELETE") | (_own() & (F.col("head") == "WITH") & _at(0, "UPDATE", "DELETE"))
    unrestricted = _own() & _is(F.col("verb"), "UPDATE", "DELETE") & (F.col("block") == F.col("n")) & F.col("b_target").isNotNull() & ~F.col("b_where")
    real_target = ~_is_temp(F.col("b_target")) & ~F.col("b_alias_temp")
    count_star = _is(F.col("name"), "COUNT", "COUNT_BIG") & _call() & _at(-1, "SELECT")
    return [
        ("hygiene.select_star", "warning", _at(0, "*") & starred & select_item & ~_is(F.col("fn"), "EXISTS", "IN") & ~(F.col("b_into") & F.coalesce(F.col("b_temp"), F.lit(False)))),
        ("hygiene.nolock", "error", _word() & _at(0, "NOLOCK", "READUNCOMMITTED") & _at(-1, "(", ",") & ~F.col("b_system")),
        ("hygiene.cursor", F.when(F.col("d_changes_rows"), "warning").otherwise("info"), _at(0, "CURSOR") & (~_like(_v(-1), "^@") | _at(-1, "=")) & (_at(-1, "=") | _at(-2, "DECLARE")) & F.col("s_user")),
        ("hygiene.top_without_order_by", "warning", _at(0, "TOP") & select_item & F.col("b_from") & ~F.col("b_order") & ~_is(F.col("fn"), "EXISTS") & ~(F.col("b_function") & (F.col("b_sources") == 1))),
        ("hygiene.unbounded_dml", "critical", unrestricted & ~F.col("b_restricts") & ~F.col("b_top") & real_target & ~F.array_contains("s_filtered_ctes", F.col("b_target")) & ~(F.col("b_derived") & ~F.col("b_alias") & (F.col("b_sources") == 0))),
        ("hygiene.global_temp_table", "warning", _word() & F.col("name").startswith("##") & (_seq("CREATE", "TABLE", start=-2) | (_at(-1, "INTO") & ~_at(-2, "INSERT", "MERGE")))),
        ("hygiene.at_at_identity", "warning", _at(0, "@@IDENTITY")),
        ("hygiene.merge_statement_for_upsert", F.when(_word_in_statement("MATCHED") & _word_in_statement("SOURCE") & _word_in_statement("BY"), "error").otherwise("warning"), F.col("first") & _at(0, "MERGE") & ~_word_in_statement("HOLDLOCK", "SERIALIZABLE")),
        ("hygiene.exec_string_no_sp_executesql", "error", _seq(("EXEC", "EXECUTE"), "(") & _like(_v(2), "^@") & _at(3, ")") & (F.array_contains("d_computed", _v(2)) | ~F.array_contains("d_constants", _v(2)))),
        ("hygiene.scalar_udf_in_select", "warning", schema_call & (F.col("clause") == "SELECT") & F.col("b_from") & ~_cond() & ~F.col("fn").startswith("CTE ")),
        ("hygiene.order_by_ordinal", "warning", _first(_number() & _own() & (F.col("clause") == "ORDER") & _at(-1, "BY", ",") & _at(1, ",", ";", "", "ASC", "DESC", ")", "OFFSET", "FOR", "OPTION") & (F.col("b_items") > 1), "block")),
        ("deprecated.set_rowcount_dml", "warning", _seq("SET", "ROWCOUNT") & ~_at(2, "0") & (_at(3, "INSERT", "UPDATE", "DELETE", "MERGE") | (_at(3, ";") & _at(4, "INSERT", "UPDATE", "DELETE", "MERGE")))),
        ("deprecated.outer_join_star_equal", "error", _at(0, "*=", "=*") & (F.col("clause") == "WHERE") & _like(_v(-1), _NAME) & _like(_v(1), _NAME)),
        ("deprecated.sp_dboption", "error", _word() & (_last() == "SP_DBOPTION")),
        ("deprecated.raiserror_legacy", "error", _at(0, "RAISERROR") & ~_at(1, "(")),
        ("deprecated.lob_legacy_types", "warning", _at(0, *_LOB) & _word() & (_typed() | declared | cast_to | (_seq("ALTER", "COLUMN", start=-3)))),
        ("sarg.function_on_column", "error", _call() & _cond() & _is(F.col("name"), *_HIDING) & compared & given & (F.col("b_user") | ~F.col("b_system"))),
        ("sarg.leading_wildcard", "warning", _string() & _like(F.col("v"), r"^' *%") & _at(-1, "LIKE") & ~_at(-2, "NOT") & _cond() & (F.col("cases") == 0) & ~_like(_v(-2), "^@")),
        ("sarg.implicit_convert_unicode", "info", _string() & F.col("unicode") & _cond() & _at(-1, "=", "<>", "!=") & _like(_v(-2), _NAME) & user_block & (F.col("cases") == 0)),
        ("sarg.not_in_nullable", "warning", _word() & _seq("NOT", "IN", "(", "SELECT", start=-1)),
        ("sarg.or_chain", "info", _first(_cond() & _at(0, "OR") & (F.col("cases") == 0) & (F.col("g_ors") >= 3) & (F.col("verb") == "SELECT"), "cond", "open")),
        ("sarg.scalar_udf_in_predicate", F.lit("error" if target is not None and target < 2019 else "warning"), schema_call & _cond()),
        ("sarg.arithmetic_on_column", "warning", F.col("ref") & _cond() & (F.col("cases") == 0) & _at(1, "+", "-", "*", "/", "%") & (_like(_v(2), r"^([0-9]|@)")) & _at(3, *_COMPARE) & ~_at(-1, *_COMPARE)),
        ("sarg.datetime_fn_between", "warning", _call() & between & ((_is(F.col("name"), "YEAR", "MONTH", "DAY") & _arg(0, "c")) | (_is(F.col("name"), "DATEPART", "DATENAME") & _arg(1, "c")))),
        ("sarg.dateadd_on_column", "warning", _call() & _cond() & (F.col("name") == "DATEADD") & _arg(2, "c") & compared),
        ("sarg.string_concat_in_predicate", "warning", F.col("ref") & _cond() & (F.col("cases") == 0) & _at(1, "+") & _like(_v(2), "^'") & ~_at(-1, "+", "LIKE") & (_is(F.col("fn"), "", *sc.RESERVED))),
        ("sarg.charindex_search_predicate", "warning", _call() & _cond() & (F.col("cases") == 0) & _is(F.col("name"), "CHARINDEX", "PATINDEX") & (_arg(0, "s") | _arg(0, "v")) & _arg(1, "c") & _is(F.get("after", F.lit(0)), *_COMPARE) & _is(F.get("after", F.lit(1)), "0", "1")),
        ("modern.missing_schema_prefix", "info", (_source() | _target()) & ~_like(F.col("name"), r"[.]|^[@#]") & ~(_source() & F.col("args").isNotNull() & _at(1, "(")) & ~F.array_contains("s_ctes", F.col("name")) & ~_at(0, "INSERTED", "DELETED", "OPENJSON", "OPENROWSET", "OPENQUERY", "OPENXML", "OPENDATASOURCE", "CASCADE") & ~(_target() & (F.col("b_alias") | F.col("b_derived")))),
        ("modern.missing_set_nocount", "info", F.col("first") & _like(F.col("head"), "^(CREATE|ALTER) PROCEDURE$") & ~F.col("n_nocount") & ~F.col("n_external")),
        ("modern.exec_string_concat", "critical", _first(_at(0, "+") & _is(F.col("fn"), "EXEC", "EXECUTE") & F.col("f_var"), "open") & ~_is(F.get("beyond", F.lit(0)), "AT")),
        ("modern.string_agg_replaces_for_xml", "info", _seq("FOR", "XML", "PATH") & _at(3, "(") & _at(4, "''") & ~F.col("b_shaped") & ~F.col("b_distinct") & (F.col("b_separated") | _is(F.col("fn"), "STUFF")) & F.lit(target is None or target >= 2017)),
        ("modern.row_number_pagination_replaces_offset_fetch", "info", _at(0, "ROW_NUMBER") & _at(5, "ORDER") & F.coalesce(F.array_contains("s_ranged", F.col("alias")), F.lit(False))),
        ("modern.greatest_least_replaces_case_when", "info", _seq("CASE", "WHEN") & _at(3, "<", ">", "<=", ">=") & _seq("THEN", start=5) & _seq("ELSE", start=7) & _seq("END", start=9) & (((_v(6) == _v(2)) & (_v(8) == _v(4))) | ((_v(6) == _v(4)) & (_v(8) == _v(2)))) & _like(_v(2), _NAME) & _like(_v(4), _NAME) & since(2022)),
        ("modern.date_bucket_replaces_floor_datediff", "info", _call() & (F.col("name") == "DATEDIFF") & _is(F.get("after", F.lit(0)), "/") & _like(F.get("after", F.lit(1)), "^[0-9@]") & ((F.col("fn") == "DATEADD") | (_seq("DATEADD", "(", start=-5) & _seq(",", "(", start=-2))) & since(2022)),
        ("modern.generate_series_replaces_numbers_cte", "info", _source() & (F.col("fn") == F.concat(F.lit("CTE "), F.col("name"))) & (F.col("b_sources") == 1) & ~F.col("b_join") & F.col("b_counts") & (F.col("b_items") == 1) & since(2022)),
        ("modern.json_native_type_opportunity", "info", _defined() & F.arrays_overlap("words", F.array(F.lit("ISJSON"))) & _at(1, "NVARCHAR") & _at(2, "(") & _at(3, "MAX") & since(2025)),
        ("modern.sp_executesql_optimized_2025", "info", (_last() == "SP_EXECUTESQL") & _at(-1, "EXEC", "EXECUTE") & _like(F.col("name"), "^(SYS[.])?SP_") & ~_at(2, "+") & since(2025)),
        ("plan.scalar_udf_block_inlining", "warning", _first((F.col("module") == "FUNCTION") & ~F.col("n_table") & ((_call() & _is(F.col("name"), *_NOW, "NEWID", "RAND")) | _at(0, "WHILE", "@@ROWCOUNT", "TRY", "CURRENT_TIMESTAMP")), "batch") & F.lit(target is None or target >= 2019)),
        ("plan.scalar_udf_in_computed_column", "warning", two_part & F.col("table").isNotNull() & _at(-1, "AS", "(") & (F.col("place") >= 1)),
        ("plan.table_variable_large", F.lit("info" if target is not None and target >= 2019 else "warning"), F.col("first") & (F.col("head") == "INSERT") & (_like(_v(1), "^@") | (_at(1, "INTO") & _like(_v(2), "^@"))) & F.col("s_user") & ~_word_in_statement("VALUES")),
        ("plan.option_recompile_overuse", "warning", _first(_recompiles()) & (F.col("d_recompiles") >= 3) & (F.col("d_recompiles") * 3 >= F.col("d_queries"))),
        ("plan.recompile_defeats_psp", "info", _recompiles() & (F.col("d_recompiles") <= 2) & F.col("s_parameter") & since(2022)),
        ("plan.optimize_for_unknown", "info", _seq("OPTIMIZE", "FOR", "UNKNOWN") | (_at(0, "UNKNOWN") & _like(_v(-1), "^@"))),
        ("plan.merge_join_hint_pinned", "warning", _word() & _seq(("LOOP", "MERGE", "HASH", "REMOTE"), "JOIN")),
        ("plan.read_committed_lock_hint_redundant_with_optimized_locking", "info", _at(0, "READCOMMITTEDLOCK") & _at(-1, "(", ",") & since(2025)),
        ("locking.set_transaction_isolation_read_uncommitted", "error", _seq("SET", "TRANSACTION", "ISOLATION", "LEVEL", "READ", "UNCOMMITTED")),
        ("locking.lock_escalation_disabled_globally", "error", (flag & (F.col("head") == "DBCC TRACEON")) | (_at(0, "T1211", "T1224") & _at(-1, "-"))),
        ("locking.dml_without_batching", "info", changes & (F.col("block") == F.col("n")) & F.col("b_where") & ~F.col("b_top") & real_target & ~F.col("b_keyed") & ~_is_system(F.coalesce(F.col("b_target"), F.lit(""))) & ~F.coalesce(F.array_contains("s_ctes", F.col("b_target")), F.lit(False))),
        ("maintenance.adr_required_for_optimized_locking", "warning", _first(_seq("OPTIMIZED_LOCKING", "=", "ON")) & ~F.col("d_recovery") & since(2025)),
        ("tempdb.spill_risk_large_sort", F.when(F.col("b_where"), "info").otherwise("warning"), _own() & _seq("ORDER", "BY") & (F.col("verb") == "SELECT") & ~F.col("b_offset") & (~F.col("b_top") | F.col("b_percent")) & ~F.col("b_xml") & ~F.col("b_assigns") & ~F.col("n_rowcount") & F.col("b_from") & ~F.col("b_temp")),
        ("tempdb.large_in_clause_constant_list", "warning", _at(0, "IN") & (_n_args() >= 50) & F.forall(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.rlike("^[ns]"))),
        ("stats.auto_create_stats_off", "error", _seq("AUTO_CREATE_STATISTICS", "OFF")),
        ("stats.auto_update_stats_off", "error", _seq("AUTO_UPDATE_STATISTICS", "OFF")),
        ("stats.update_statistics_fullscan_on_huge_table", "info", _seq("UPDATE", "STATISTICS") & _word_in_statement("FULLSCAN") & ~_word_in_statement("INCREMENTAL")),
        ("stats.ascending_key_hotspot", "info", F.col("ref") & _cond() & _at(1, ">", ">=") & _at(2, "DATEADD") & _at(3, "(") & _at(6, "-") & _any(*[_at(i, *_NOW) for i in (9,)]) & F.col("b_user") & ~F.col("b_system") & ~F.col("b_function")),
        ("joins.right_outer_join_readability", "info", _seq("RIGHT", "JOIN") | _seq("RIGHT", "OUTER", "JOIN")),
        ("joins.comma_cross_join", "warning", _first(_own() & _at(0, ",") & (F.col("clause") == "FROM") & _is(F.col("verb"), *_DML), "block")),
        ("joins.join_without_on", "error", _first(_own() & _at(0, "JOIN") & ~_at(-1, "CROSS"), "block") & (F.col("b_ons") < F.col("b_joins")) & (F.col("verb") != "MERGE")),
        ("joins.function_on_join_column", "warning", _call() & (F.col("clause") == "ON") & _cond() & _is(F.col("name"), *_HIDING_JOINS) & given & compared & (F.col("cases") == 0) & ~_is(F.col("name"), "ISNULL", "COALESCE") & (F.col("b_user") | ~F.col("b_system"))),
        ("joins.distinct_with_join_fanout", "info", _at(0, "DISTINCT") & _at(-1, "SELECT") & _own() & F.col("b_join")),
        ("antipattern.count_for_existence", "info", count_star & _arg(0, "o*") & (F.col("cases") == 0) & _like(F.concat_ws(" ", "beyond"), r"^(=|>|>=|<|<>|!=) (0|1)$")),
        ("antipattern.union_should_be_union_all", "info", _at(0, "UNION") & ~_at(1, "ALL") & (F.size("f_sources") >= 2) & (F.size(F.array_distinct("f_sources")) == F.size("f_sources")) & F.col("f_real")),
        ("antipattern.distinct_many_columns", "info", _at(0, "DISTINCT") & _at(-1, "SELECT") & _own() & (F.col("b_items") >= 5) & ((F.col("b_sources") > 1) | F.col("b_join"))),
        ("config.auto_shrink_on", "warning", database & _seq("AUTO_SHRINK", "ON")),
        ("config.auto_close_on", "warning", database & _seq("AUTO_CLOSE", "ON")),
        ("config.page_verify_not_checksum", "warning", database & _seq("PAGE_VERIFY", ("NONE", "TORN_PAGE_DETECTION"))),
        ("config.recovery_model_simple", "info", database & _seq("RECOVERY", "SIMPLE")),
        ("config.dbcc_shrink", "warning", _seq("DBCC", ("SHRINKDATABASE", "SHRINKFILE")) & ~_word_in_statement("EMPTYFILE", "TRUNCATEONLY")),
        ("config.dbcc_traceon_global", "warning", _seq("DBCC", "TRACEON") & F.col("s_everywhere") & ~F.col("s_escalation")),
        ("config.maxdop_zero", "warning", sets("MAX DEGREE OF PARALLELISM", "0")),
        ("config.cost_threshold_default", "warning", sets("COST THRESHOLD FOR PARALLELISM", "5")),
        ("security.xp_cmdshell", "critical", (_word() & (_last() == "XP_CMDSHELL")) | (configures & _at(0, "'XP_CMDSHELL'"))),
        ("security.grant_to_public", "warning", (F.col("head") == "GRANT") & (F.col("name") == "PUBLIC") & _at(-1, "TO", ",")),
        ("security.grant_control", "warning", (F.col("head") == "GRANT") & _at(0, "CONTROL") & _at(-1, "GRANT", ",")),
        ("security.grant_with_grant_option", "warning", _seq("WITH", "GRANT", "OPTION")),
        ("security.add_to_privileged_role", F.when(privileged("critical"), "critical").when(privileged("error"), "error").otherwise("warning"), adds_member & (privileged("critical") | privileged("error") | privileged("warning"))),
        ("security.execute_as_without_revert", "warning", _first(_seq(("EXEC", "EXECUTE"), "AS", ("LOGIN", "USER")) & F.col("first"), "batch") & (F.col("n_as") > F.col("n_reverts"))),
        ("security.openrowset_inline_credentials", "error", _is(F.col("v"), "OPENROWSET", "OPENDATASOURCE") & _call() & F.exists(F.coalesce("args", F.array().cast("array<string>")), lambda a: a.rlike(r"(?i)(PWD|PASSWORD)\s*=\s*[^;']+") & a.rlike(r"(?i)(UID|USER ID)\s*="))),
        ("tran.begin_without_try_catch", "warning", _first(_begins_tran()) & F.col("d_commits") & ~F.col("d_tries") & ~F.col("d_rolls_back_to")),
        ("tran.begin_without_commit", "warning", _first(_begins_tran()) & ~F.col("d_commits") & ~F.col("d_rolls_back")),
        ("tran.close_without_begin", "warning", _first(_at(0, "COMMIT", "ROLLBACK") & F.col("first") & ~(_at(1, *_TRAN) & F.coalesce(F.array_contains("n_saved", _v(2)), F.lit(False))), "batch") & ~F.col("n_begins") & ~F.col("n_guard") & (F.col("module") != "TRIGGER")),
        ("tran.missing_xact_abort", "warning", _first(_begins_tran(), "batch") & (F.col("n_changes") >= 2) & ~F.col("n_xact") & ~F.col("d_tries")),
        ("tran.ddl_inside_explicit_tran", "warning", ddl & in_tran & ~temp_ddl & ~_like(F.col("head"), "^ALTER DATABASE")),
        ("datatype.implicit_string_length", F.when(F.col("table").startswith("@"), "info").otherwise("warning"), typed(*_STRINGS) & ~_at(1, "(")),
        ("datatype.implicit_string_length_cast", "warning", _at(0, *_STRINGS) & cast_to & ~_at(1, "(") & ~(_is(F.col("fn"), "CONVERT", "TRY_CONVERT") & F.col("f_styled"))),
        ("datatype.float_for_money", "warning", typed("FLOAT", "REAL") & money),
        ("datatype.datetime_legacy", "info", typed("DATETIME")),
        ("datatype.sysname_general_string", "info", typed("SYSNAME") & ~_like(column_name, _METADATA)),
        ("ddl.varchar_max_overuse", "info", typed("VARCHAR", "NVARCHAR") & _seq("(", "MAX", ")", start=1)),
        ("compat.unsupported_on_target", "error", newer | newer_clause),
        ("joins.outer_join_filtered_to_inner", "warning", _first(F.col("ref") & (F.col("clause") == "WHERE") & _cond() & (F.col("cases") == 0) & (F.col("b_ors") == 0) & _at(1, *_COMPARE, "LIKE", "IN", "BETWEEN") & (F.array_contains("b_left", F.element_at(F.split("name", r"\."), 1)) | F.array_contains("b_right", F.element_at(F.split("name", r"\."), 1))) & _like(F.col("name"), r"\.") & (F.col("fn") != "EXISTS"), "block")),
        ("index.missing_columnstore_opportunity", "info", simple & (F.col("block") == F.col("n")) & F.col("b_group") & F.col("b_aggregate") & ~F.col("b_top") & ~cte_source & (F.col("within") != "FROM")),
        ("index.filtered_index_opportunity_soft_delete", "info", _first(F.col("ref") & simple & ~cte_source & (F.col("clause") == "WHERE") & _at(-1, "WHERE") & (F.col("b_and") == 0) & (_seq("=", ("0", "'Y'", "'N'"), start=1) | _seq("IS", "NULL", start=1)) & ~_is(F.col("fn"), "EXISTS"))),
        ("index.wide_covering_request", "info", _at(0, "INCLUDE") & _like(F.col("head"), "^CREATE INDEX") & (_n_args() > 5)),
    ]


def findings(tokens: DataFrame, target: int | None = 2025) -> DataFrame:
    """(doc_id, rule, severity, line, col, start) of all rules that fire on the scripts of ``tsql.tokens`` on servers of the year ``target``; null if not known."""
    return findings_in(sc.scopes_of_tokens(tokens), target)


def _object() -> Column:
    """What a finding is about, as far as its unit says: the table or function that the unit names, the table that it defines, or the table of its query block."""
    named = F.col("role").isNotNull() | F.col("args").isNotNull() & _like(F.col("name"), _NAME)
    column = F.when(F.col("ref") & F.col("table").isNull(), F.col("name"))
    defined = F.when(F.col("place") == 1, F.concat(F.col("table"), F.lit("."), F.upper("spelt")))
    name = F.coalesce(defined, F.when(named, F.col("name")), column, F.col("table"), F.col("b_target"), F.col("b_source"))
    return F.nullif(F.translate(name, "[]", ""), F.lit(""))


def findings_in(units: DataFrame, target: int | None = 2025, objects: bool = False) -> DataFrame:
    """The same from ``scopes.scopes``; with ``objects`` each finding names what it is about, in upper case, as far as the script says."""
    return _findings(sc.side_by_side(units), target, objects)


def findings_of(scripts: DataFrame, target: int | None = 2025, objects: bool = False) -> DataFrame:
    """The same from scripts (doc_id, sql), whose units aren't shuffled but for scripts that are too long for a task."""
    return _findings(sc.together(scripts), target, objects)


def _findings(units: DataFrame, target: int | None, objects: bool) -> DataFrame:
    def hit(rule: str, severity: str | Column, when: Column | _Nth) -> Column:
        nth = when if isinstance(when, _Nth) else _Nth(when, F.lit(None).cast("string"), 0)
        also = F.lit(True) if nth.also is None else F.coalesce(nth.also, F.lit(False))
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(F.coalesce(nth.hit, F.lit(False)), F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), nth.key.alias("key"), also.alias("also"), F.lit(nth.most).alias("most")))

    t = with_facts(units)
    own = ["line", "col", "start", *(["object"] if objects else [])]
    found = t.select("doc_id", "n", "line", "col", "start", *([_object().alias("object")] if objects else []), F.array(*[hit(*r) for r in _rules(target) + _declared_rules()]).alias("found"))
    hits = evenly(found.select("doc_id", "n", *own, F.explode(F.filter("found", lambda f: f.isNotNull())).alias("f")).select("doc_id", "n", *own, "f.*"), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id", "rule", "key").orderBy("n"))
    kept = hits.withColumn("place", place).where((F.col("most") == 0) | ((F.col("place") <= F.col("most")) & F.col("also")))
    return kept.select("doc_id", "rule", "severity", *own)
