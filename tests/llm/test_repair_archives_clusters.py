"""Conversation repair, archives and ball k-means against plain versions, and on odd rows."""

import glob
import gzip
import hashlib
import heapq
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import ball_kmeans, conversation_repair, warc_archives

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_damage(rows):
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        for _ in range({0: 0, 3: 2}.get(k, 1)):
            yield conv, turn, "user" if k == 4 else role, text


def cheapest(rows):
    """(cost, audit, lines) by trying all edits; rows are (role, text, fault)."""

    def allowed(before, initial):
        return initial if (not before and initial in "su") or (before in ("s", "a") and initial == "u") or (before == "u" and initial == "a") else None

    @lru_cache(None)
    def rest(i, before, inserted):
        found = [(0, "", ())] if i == len(rows) and before in ("", "a") else []

        def add(cost, letter, line, j, now, more=0):
            c, audit, lines = rest(j, now, more)
            found.append((cost + c, letter + audit, ((line,) if line is not None else ()) + lines))

        if inserted < 3:
            for role in ("user", "assistant"):
                if allowed(before, role[0]):
                    add(2, "I", role + ":", i, role[0], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            add(3, "D", None, i + 1, before)
            if fault not in ("blank", "duplicate"):
                cut = int(fault == "truncated")
                if role[:1] and allowed(before, role[:1]):
                    add(cut, "K", f"{role}:{text}", i + 1, role[:1])
                for new in ("user", "assistant"):
                    if allowed(before, new[0]):
                        add(2 + cut, "R", f"{new}:{text}", i + 1, new[0])
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def plain_repair(original):
    by = {}
    for conv, *_ in original:
        by[conv] = []
    for conv, *row in plain_damage(original):
        by[conv].append(tuple(row))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in rows:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, lines = cheapest(tuple(judged))
        n = lambda f: sum(x[2] == f for x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def made_conversations():
    rng, rows = random.Random(7), []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2, -turn]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ärger"]), rng.choice(["Yes.", "No", "Why?", "", None, " \t", "a:b\nc!", "Yes. ", "ü"])))
    return rows + rows[:20] + [(61, 5, "user", "Same.")] * 40


@pytest.mark.parametrize("parts", [None, 1, 9, 40])
def test_repair_against_all_edits(spark, parts):
    rows = made_conversations()
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"fault": F.lit("x"), "part": F.lit(3), "copies": F.lit(9)}).repartition(5)
    got = conversation_repair.repair(conversation_repair.damaged(df), parts).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain_repair(rows) and len(got) == len({r[0] for r in rows})


def test_one_long_conversation_over_many_tasks(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Fine. ", "Cut "]) + str(t) + rng.choice([".", ""])) for t in range(3000)] + [(0, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, COLUMNS)
    damaged = conversation_repair.damaged(df)
    whole, split = ({r["conv_id"]: tuple(r) for r in conversation_repair.repair(damaged, n).collect()} for n in (1, 11))
    assert whole == split and len(whole[1][7]) > 2500
    turns = conversation_repair.repaired_turns(damaged, 11).where("conv_id = 1").collect()
    assert len({r["part"] for r in turns}) > 5
    assert sha("\n".join(f"{r['role']}:{r['text']}" for r in sorted(turns, key=lambda r: (r["part"], r["place"])))) == whole[1][8]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert conversation_repair.repair(conversation_repair.damaged(none)).count() == 0
    dropped = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame([(dropped, 0, "user", "x")], COLUMNS))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]


BIG = "<p>" + "x" * 97
TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
PAGES = [(1, "https://www.B.org/a?x#y", BIG), (2, "http://b.org:80/a?x", BIG), (3, None, None), (4, "", ""), (5, "http://a.org", "short"), (6, "http://a.org", "short"), (7, "http://a.org/\r\nX: y", TRAP), (8, "ftp://u@a.org/é", TRAP), (9, "http://a.org", "é" * 50), (10, "http://c.org", "é" * 49), (None, "http://b.org/a?x", BIG), (2, "http://b.org:80/a?x", BIG), (1, "https://www.B.org/a?x#y", BIG), (None, "n", "n" * 200), (11, "long", "long " * 300_000)] + [(100 + i, f"http://hot.org/{i % 7}", "hot " * 40) for i in range(300)]


def plain_pages(rows):
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    for i, _, html in rows:
        b = (html or "").encode()
        to = first.get(html) if len(b) >= 100 else None
        yield i, len(b), hashlib.sha256(b).hexdigest(), *(("response", None) if to is None or to == i else ("revisit", to))


def unpacked(folder):
    for f in glob.glob(f"{folder}/*.gz"):
        yield f.rpartition("/")[2], gzip.open(f).read()


@pytest.mark.parametrize("parts", [None, 5])
def test_archives(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(warc_archives, "RECORDS", 17)
    folder = str(tmp_path / "w")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"captured_at": F.timestamp_seconds(F.col("page_id") % 50), "place": F.lit("x"), "key": F.lit(0), "first": F.lit(1)}).repartition(6)
    got = warc_archives.archived(df, folder, parts).collect()
    assert sorted(str(tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) for r in got) == sorted(str(x) for x in plain_pages(PAGES))
    in_order = sorted(got, key=lambda r: (r["part"], r["place"]))
    keys = [(r["url_key"], r["captured_at"] or "", r["page_id"] if r["page_id"] is not None else -(1 << 63)) for r in in_order]
    assert keys == sorted(keys) and len({r["archive"] for r in got}) > 10
    assert {r["page_id"]: r["url_key"] for r in got if r["page_id"] in (1, 2, 3, 7, 8)} == {1: "org,b)/a?x", 2: "org,b)/a?x", 3: ")/", 7: "org,a)/%0D%0AX: y", 8: "org,a)/é"}
    files = dict(unpacked(folder))
    for r in got:
        record = files[r["archive"]][r["offset"] : r["offset"] + r["length"] + 4]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Type: {r['record_type']}\r\n".encode() in record
    assert sum(map(len, files.values())) == sum(r["length"] + 4 for r in got)


def test_archives_that_lie_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(b"ab").hexdigest().encode() + b"\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    read = lambda raw: list(warc_archives._captures("a", memoryview(raw)))
    assert [x["page_id"] for x in read(gzip.compress(good) + gzip.compress(good))] == [1, 1]
    for bad in (good.replace(b"ab\r", b"ac\r"), good[:-2], b"junk\r\n" + good, good.replace(b"Length: 40", b"Length: 39")):
        with pytest.raises((warc_archives.Broken, ValueError)):
            read(gzip.compress(bad))


def test_no_pages(spark, tmp_path):
    assert warc_archives.archived(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    streams = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(0, 12))) for i in range(k)]
    assert list(warc_archives.LoserTree([iter(s) for s in streams])) == list(heapq.merge(*streams))


def plain_clusters(rows, k=8, size=64, rounds=10):
    kept = [(i, [int(np.floor(1024 * min(max(float(x), -131072.0), 131072.0))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))
    centres = [c for _, c in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    total = [sum(d for d, m in near if m == n) for n in range(len(centres))]
    top = (1 << 63) - 1
    return [(i, n, d, min(total[n], top), min(sum(total), top), sha(",".join(map(str, centres[n])))) for (i, _), (d, n) in zip(kept, near)]


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.4, 64).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, [float(i % 2)] * 64) for i in range(30)] + [(1, rows[1][1]), (1, rows[1][1]), (None, [0.5] * 64)]
    odd = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 63 + [None]), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63), (406, [1.0] * 65)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "whole": F.lit(0), "points": F.lit(1)}).repartition(3)
    assert sorted(str(tuple(r)) for r in ball_kmeans.cluster(df).collect()) == sorted(str(x) for x in plain_clusters(rows))
    few = rows[:5] + [(9, [3.0e38] * 64), (10, [-3.0e38] * 64)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted(str(tuple(r)) for r in ball_kmeans.cluster(df).collect()) == sorted(str(x) for x in plain_clusters(few))
    assert ball_kmeans.cluster(df.limit(0)).count() == 0 and ball_kmeans.cluster(df.where("vec_id = 1")).count() == 1


def test_balls_spare_distances_and_keep_ties():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (16, 8)).astype(np.int64)
    centres[7] = centres[3]
    points = (centres[rng.integers(0, 16, 2000)] + rng.integers(-900, 900, (2000, 8))).astype(np.int64)
    points[:50] = (centres[0] + centres[1]) // 2
    apart = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
    for before in (apart.argmin(axis=1).astype(np.uint8), rng.integers(0, 16, 2000).astype(np.uint8)):
        found, least, computed = ball_kmeans.reassigned(points, before, centres)
        assert (found == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    assert ball_kmeans.reassigned(points, apart.argmin(axis=1).astype(np.uint8), centres)[2] < 0.4 * apart.size
