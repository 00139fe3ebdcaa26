
import random
from itertools import combinations

from fleetlens.llm import license_scans

SF = "/root/testdata/sf0.001"


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_duplicate_stage_links_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for j, n in enumerate((2, 4, 6, 25)):
            x = list(w)
            for at in rng.sample(range(300), n):
                x[at] = "edited"
            rows.append((100 * (j + 1) + i, " ".join(x)))
    sets = {i: five(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(i, j) for i, j in combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    kept = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))
    assert len(set(label.values())) < 100


def test_near_copies_of_nulls_and_repeated_ids(spark):
    from fleetlens.llm import near_copies

    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  two"), (5, "c d e f g h"), (5, "i j k l m n"), (None, "one two"), (None, "alone here"), (None, "alone here")]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, None), (3, "One two"), (5, "c d e f g h"), (5, "i j k l m n"), (None, "alone here")]))



def test_noise_at_the_end_of_short_and_middling_texts(spark):
    import base64

    from fleetlens.llm import quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "text")
    clean = [(r["doc_id"], r["text"]) for r in quality_rules.keep_good(docs).collect() if 2000 < len(r["text"].encode()) < 7000]
    noise = base64.b64encode(random.Random(7).randbytes(1125)).decode()
    rows = [(i, f"{t} {noise}") for i, t in clean]
    assert len(rows) > 10
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == 0
    # a last partial chunk alone
    last = [(i, t.encode()[:4096].decode(errors="ignore") + noise[:700]) for i, t in clean if len(t.encode()) > 4096]
    assert last and quality_rules.keep_good(spark.createDataFrame(last, "doc_id long, text string")).count() == 0



MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD2 = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3 = """Foo does things
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.
"""
GPL2 = """Foo is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
LICENCES = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "Apache-2.0": APACHE}


def test_published_licence_texts(spark):
    from fleetlens.llm import license_scans

    def commented(text, begin, leader, end):
        return begin + "".join(f"{leader} {x}".rstrip() + "\n" for x in text.splitlines()) + end

    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split("\n")), lambda t: commented(t, "/*\n", " *", " */\nint x;\n"), lambda t: commented(t, "", "#", "import os\n"), lambda t: commented(t, "", "//", "\nx()\n"), lambda t: commented(t, "", "dnl", "AC_INIT\n"), lambda t: t.replace('"', "”")]
    rows = [(100 * i + j, shape(t)) for i, t in enumerate(LICENCES.values()) for j, shape in enumerate(shapes) if not (j == 2 and t is not GPL2)]
    got = {r["doc_id"]: r["license"] for r in license_scans.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = list(LICENCES)
    assert got == {i: names[i // 100] for i, _ in rows}



def test_leaders_with_few_followers_over_many_shards(spark):
    import pytest

    from fleetlens.llm import lm_scoring
    from test_operators import plain_scores

    rows = [(i, f"the x{i} " * 40) for i in range(40)]
    want = dict(plain_scores(rows))
    for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=200, chunk_bytes=800).collect():
        w = want[r["doc_id"]]
        assert r["score"] == pytest.approx(w[5], rel=0.02, abs=0.02 * w[1])



def test_rows_that_share_a_doc_id_stay_apart_over_blocks(spark):
    from fleetlens.llm import decontamination

    rows = [(None, "a one two b"), (None, "c three four d"), (None, "e f g h"), (1, "one two three four"), (1, "one two three four"), (1, "three four x y"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("p", "one two"), ("q", "three four"), ("r", "two three")], "item_id string, text string")
    found = lambda n: sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["spans"])) for r in decontamination.find_hits(docs, bench, block_bytes=n).collect())
    assert found(1) == found(1 << 20)
    assert len(found(1)) == len(rows)

ISC = """Copyright (c) 2020, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy it.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
CC = "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.\n"
SPDX = "// SPDX-License-Identifier: BSD-3-Clause\n#include <x.h>\n"


def test_more_published_licence_texts(spark):
    from fleetlens.llm import license_scans

    texts = {"ISC": ISC, "Unlicense": UNLICENSE, "Zlib": ZLIB, "MPL-2.0": MPL, "LGPL-2.1-or-later": LGPL21, "AGPL-3.0-or-later": AGPL, "CC-BY-NC-SA-4.0": CC, "BSD-3-Clause": SPDX}
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(100 + i, "".join(f" * {x}\n" for x in t.splitlines())) for i, t in enumerate(texts.values()) if i < 7]
    got = {r["doc_id"]: r["license"] for r in license_scans.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: list(texts)[i % 100] for i, _ in rows}


def test_padding_doesnt_hide_a_sentence(spark):
    from fleetlens.llm import license_scans

    rows = [(1, "released under" + " " * 5000 + "the MIT" + "-" * 5000 + "license")]
    assert license_scans.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).first()["license"] == "MIT"


def test_one_row_of_a_component_stays(spark):
    from fleetlens.llm import simhash_dedup

    rows = [(2, "a b c d", "x"), (5, "some other words here", "x"), (5, "a b c d", "x"), (7, "some other words here", "y"), (None, "only here is this", "z"), (None, "only here is this", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep string")
    got = simhash_dedup.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(2, "a b c d", "x"), (5, "some other words here", "x"), (None, "only here is this", "z")]))


def test_unknown_labels_dont_count(spark):
    from fleetlens.llm import url_filters
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, None if i < 40 else 1, 0) for i in range(80)], "page_id long, quality int, toxic int")
    outcomes = labels.select("page_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    pages = spark.createDataFrame([(i, f"http://{'a' if i < 40 else 'b'}.net/") for i in range(80)], "page_id long, url string")
    assert {r["verdict"] for r in url_filters.filter_urls(pages, outcomes).collect()} == {"allow"}


def test_a_cluster_must_name_its_folder(monkeypatch):
    import pytest

    from fleetlens.llm import _common

    class Spark:
        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            class Option:
                                @staticmethod
                                def isDefined():
                                    return False

                            return Option

                    return Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.ensure_checkpoint_dir(Spark)


def test_open_places_and_spdx_expressions(spark):
    owner = lambda name: BSD3.replace("the copyright holder", name)
    texts = [
        (owner("Google Inc."), "BSD-3-Clause"), (owner("the Regents of the University of X"), "BSD-3-Clause"), (owner("Foo, Ltd. & Sons"), "BSD-3-Clause"), (BSD2, "BSD-2-Clause"),
        ("This project is licensed under the MIT License.", "MIT"), ("The source code is released under the MIT License.", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("This library is distributed under the terms of the Apache License, Version 2.0.", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"), ("// SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("SPDX-License-Identifier: (ISC AND GPL-2.0-or-later)", "GPL-2.0-or-later,ISC"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "LGPL-3.0-or-later"),
        ("We think this text is licensed under no terms at all.", ""), ("Neither the name of the game nor the names of its players matter.", ""), ("", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scans.scan_licenses(df).collect()}
    assert [got[i]["licenses"] if "," in want else got[i]["license"] or "" for i, (_, want) in enumerate(texts)] == [want for _, want in texts]


def test_a_notice_below_many_lines_of_its_block(spark):
    text = "\n".join([f"row {i}" for i in range(150)] + ["permission to use, copy, modify, and/or distribute this software for any", "purpose with or without fee is hereby granted"])
    got = license_scans.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["licenses"] == "0BSD"


def test_near_copies_of_odd_columns_and_equal_rows(spark):
    from pyspark.sql import functions as F

    from fleetlens.llm import near_copies

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (2, text + " end", "c"), (3, "other words stand here", "d"), (None, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string").withColumns({"_id": F.lit("x"), "_hash": F.lit(1), "odd.name": F.lit(2), "_row": F.lit(3), "component": F.lit(4)})
    for _ in range(2):
        kept = near_copies.keep_one(df.repartition(3))
        assert kept.dtypes == df.dtypes
        assert sorted(map(str, ((r["doc_id"], r["other"], r["odd.name"]) for r in kept.collect()))) == sorted(map(str, [(1, "a", 2), (3, "d", 2), (None, "e", 2)]))
    assert near_copies.keep_one(df.limit(0)).count() == 0 and near_copies.keep_one(df.select("doc_id", "text")).count() == 3


def test_windows_of_one_hash_stay_apart(monkeypatch):
    import pickle

    import numpy as np
    from xxhash import xxh64_intdigest

    from fleetlens.llm import decontamination as d

    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n)).encode()
    items = [(f"i{i}", text(rng.choice([0, 1, 2, 3, 5, 8]))) for i in range(60)]
    docs = [d.words_of(text(n)) for n in (0, 1, 2, 40, 300)]

    def plain(words, window):
        hit, names = [False] * len(words), set()
        for name, t in items:
            w = d.words_of(t)
            k = min(window, len(w))
            for i in range(len(w) - k + 1 if w else 0):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hit[j : j + k] = [True] * k
                        names.add(name)
        return hit, names

    few = lambda words, n: np.fromiter((xxh64_intdigest(w) % 3 for w in words), np.uint64, n)
    for hashed in (d.hashed, few):
        monkeypatch.setattr(d, "hashed", hashed)
        w = pickle.loads(pickle.dumps(d.Windows(items, 3)))
        hit, names = w.scan(docs)
        ends = np.cumsum([len(x) + 1 for x in docs]) - 1
        for x, e, found in zip(docs, ends, names):
            assert (hit[e - len(x) : e].tolist(), found) == plain(x, 3)
    large = [(str(i), " ".join(f"w{rng.randrange(50_000)}" for _ in range(100)).encode()) for i in range(1500)]
    assert len(pickle.dumps(d.Windows(large, 10))) < 8 * sum(len(t) for _, t in large)


def test_empty_tables_and_clashing_names(spark):
    from pyspark.sql import functions as F

    from fleetlens.llm import decontamination, quality_rules, url_filters

    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (2, "http://a.org:80/y"), (None, "ftp://u@b.co.id/")], "page_id long, url string")
    good = spark.createDataFrame([(1, 1), (9, 0)], "page_id long, good int")
    assert url_filters.filter_urls(pages.limit(0), good).count() == 0
    clashing = pages.withColumns({c: F.lit("x") for c in ("host", "domain", "suffix", "rule", "verdict", "good", "n", "k")})
    got = {(r["page_id"], r["host"], r["path"]) for r in url_filters.filter_urls(clashing.select(*clashing.columns), good).collect()}
    assert got == {(1, "a.org", "/x"), (2, "", ""), (2, "a.org:80", "/y"), (None, "u@b.co.id", "/")}
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "s", 3)], "doc_id long, text string, n_words string, hit int")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for kept in (quality_rules.keep_good(docs.limit(0)), decontamination.remove_contaminated(docs.limit(0), items)):
        assert kept.columns == docs.columns and kept.count() == 0
    assert decontamination.remove_contaminated(docs, items.limit(0)).count() == 1 and decontamination.remove_contaminated(docs, items).count() == 0
