"""The corpus operators against SQL, brute force and planted edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strayfield.llm import exact_dedup, html_extract, license_scan, minhash, mixing, packing, quality, queries, sharding, suffix_dedup, url_filter
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = "the cat sat on the mat and the dog lay in the sun while rain fell on the old stone wall near the river. " * 3
#: NULLs, an empty text, white space only, ties, repeated rows and rows that share an id
ODD = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "b"), (4, "one  two", "a"), (5, "one\ttwo", "b"), (None, "one two", "a"), (6, LONG, None),
    (7, LONG + "More.", "a"), (8, LONG, "b"), (8, LONG, "b"), (None, None, None), (9, "x" * 5000, "c"), (9, "other text", "c"),
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    assert compare(queries.all_queries()[name](spark, FOLDER).toPandas(), con.execute(queries.SQL[name]).df()) is None


def test_every_operator_has_a_query():
    assert {re.match(r"op\d+|pipeline", n)[0] for n in queries.all_queries()} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


# 1 url rules


def test_url_rules_brute_force(spark):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "a-b", "com", "net"])
    rules = [(".".join(label() for _ in range(rng.randint(1, 3))), rng.choice(["/", "/x/", "/x/y", "/z"]), rng.choice(["block", "allow"])) for _ in range(60)]
    urls = [(i, f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/x/y/1', '/x/', '/z?q#f', '#top'])}") for i in range(400)]
    urls += [(1000, None), (1001, "no scheme"), (1002, "HTTP://A.COM/x/y"), (1003, "http://"), (1003, "http://")]
    frame = spark.createDataFrame(urls, "page_id int, url string").selectExpr("page_id", "url", "'mine' as rule", "1 as key", "2 as tie")
    got = url_filter.judged(frame, spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) and set(got[0].asDict()) == {"page_id", "url", "key", "tie", "host", "path", "rule", "verdict"}
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if m and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[3], best[4] if best else "allow")


def test_url_rules_empty(spark):
    none, rules = spark.createDataFrame([], "page_id int, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judged(none, rules).count() == 0
    assert url_filter.judged(spark.createDataFrame([(1, "http://a.b/")], "page_id int, url string"), rules).first()["verdict"] == "allow"


# 2 exact dedup


def exact_groups(rows):
    out = defaultdict(list)
    for i, t, *_ in rows:
        out[hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()].append(i)
    return out


@pytest.mark.parametrize("copies", [0, 500])
def test_exact_dedup(spark, copies):
    rows = ODD + [(100 + i, "hot text", "a") for i in range(copies)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as keep_id", "2 as sha", "3 as n")
    got = exact_dedup.labelled(frame).collect()
    groups = exact_groups(rows)
    best = {d: min(ids, key=lambda i: (i is None, i or 0)) for d, ids in groups.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, d) for d, ids in groups.items() for i in ids)
    assert all((r.keep_id, r.group_size) == (best[r.text_sha256], len(groups[r.text_sha256])) for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.deduplicated(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((i is None, i or 0) for i in best.values())


def test_exact_dedup_empty(empty):
    assert exact_dedup.labelled(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


# 3 mixing


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] and s not in capped}
        if not over:
            return target
        capped |= over


def test_mixing(spark, docs):
    frame = docs.selectExpr("doc_id", "text", "case when source in ('src1', 'src2', 'src3', 'src4', 'src5') then source when source = 'src6' then null else 'src0' end source", "1 as mix_size", "2 as lay_rows")
    mix = mixing.mixed(frame)
    got, rows = mixing.taken(mix).toPandas(), {r.doc_id: r for r in frame.collect()}
    sizes = defaultdict(int)
    for r in rows.values():
        sizes[r.source] += len(words(r.text))
    target, drawn = fair_targets(sizes), defaultdict(int)
    for r in got.itertuples():
        source = rows[r.doc_id].source
        assert r.size == len(words(rows[r.doc_id].text)) and r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6 * target[source] and 0 <= r.taken <= 3 * r.size
        drawn[source] += r.taken
    assert len(got) == len(rows) and all(abs(drawn[s] - t) < 0.01 * t + 2 for s, t in target.items())
    again = mixing.taken(mixing.mixed(frame.repartition(5))).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    parts = mixing.documents(mix, frame.columns)
    taken = Counter()
    for r in parts.collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.text in rows[r.doc_id].text
    assert taken == Counter({r.doc_id: r.taken for r in got.itertuples() if r.taken})
    assert {r.mix_shard for r in mix.where("mix_words is not null").select("mix_shard").distinct().collect()} == set(range(mixing.SHARDS))


def test_mixing_odd(spark, odd, empty):
    got = mixing.taken(mixing.mixed(odd)).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(words(t))) for i, t, _ in ODD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.taken(mixing.mixed(empty)).count() == 0


def test_quota_tree(spark):
    quotas = {"a": 1000, "b": 37, None: 0, "c": 5}
    runs = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 7).collect()
    for s, q in quotas.items():
        own = sorted((r.shard, r.first, r.past) for r in runs if r.source == s)
        assert [x[0] for x in own] == list(range(7)) and own[0][1] == 0 and own[-1][2] == q and all(a[2] == b[1] for a, b in zip(own, own[1:]))
    for i in range(7):
        assert sum(r.past - r.first for r in runs if r.shard == i) == 1042 * (i + 1) // 7 - 1042 * i // 7


def test_hypergeometric_draws(spark):
    from math import comb

    from pyspark.sql import functions as F

    u = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("k"))
    seen = Counter(r.k for r in u.collect())
    for k in range(11):
        assert abs(seen[k] / 4000 - comb(12, k) * comb(18, 10 - k) / comb(30, 10)) < 1e-3
    n = spark.range(301).select(mixing.permuted(F.col("id"), F.lit(301), F.lit(5)).alias("p"))
    assert sorted(r.p for r in n.collect()) == list(range(301))


# 4 resharding


def test_fewest_moves():
    rng = random.Random(2)
    for _ in range(200):
        old, k = [rng.randint(0, 30) for _ in range(rng.randint(1, 6))], rng.randint(1, 6)
        room = [sum(old) * (i + 1) // k - sum(old) * i // k for i in range(k)]
        flow = sharding.fewest_moves(old, room)
        assert all(sum(b for i, _, b in flow if i == o) == x for o, x in enumerate(old)) and all(sum(b for _, j, b in flow if j == o) == x for o, x in enumerate(room))
        least = sum(max(0, b - (room[i] if i < k else 0)) for i, b in enumerate(old))  # these bytes cannot stay
        assert sum(b for i, j, b in flow if i != j) == least


def test_resharding(spark, docs, odd, empty):
    got = queries.op4_sharding(spark, FOLDER).toPandas()
    want = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(want) and all(r.size == len(want[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(want[r.doc_id]) for r in got.itertuples())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.shard) == set(range(8))
    largest = got["size"].max()
    assert (abs(got.groupby("shard")["size"].sum() - got["size"].sum() / 8) < 3 * largest).all()
    rows = sharding.resharded(odd.selectExpr("*", "1 as slot", "2 as row_rank"), "source", shards=2).collect()
    assert len(rows) == len(ODD) and Counter(r.text for r in rows) == Counter(t for _, t, _ in ODD)
    assert sharding.resharded(empty, "source").count() == 0


def test_rewrite(spark, tmp_path):
    frame = spark.createDataFrame([(i, "x" * 9, "abc"[min(i // 40, 2)]) for i in range(100)], SCHEMA)
    placed = sharding.resharded(frame, "source", shards=3)
    touched = {r.shard for r in sharding.rewritten(placed).collect()}
    sharding.rewrite(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert set(back.shard) == touched and len(back) == placed.where(placed.shard.isin(*touched)).count()


@pytest.mark.parametrize("olds", [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None], [0, 1, 2], [0, 2, 3, 9]])
def test_rewrite_in_place(spark, tmp_path, olds):
    from pyspark.sql import functions as F

    per = {0: 40, 1: 40, 2: 90}
    rows = [(o * 1000 + i if o is not None else 99_000 + i, f"{i:08d}", o) for o in olds for i in range(per.get(o, 25))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, old int")
    folder, missing = str(tmp_path / "shards"), max(o for o in olds if o is not None) + 1
    frame.withColumn("shard", F.coalesce("old", F.lit(missing))).drop("old").write.partitionBy("shard").parquet(folder)
    room = [40, 40, 60, 30] if olds == [0, 1, 2] else None  # here 0 and 1 are not touched
    placed = sharding.resharded(frame, "old", shards=4 if room else 8, room=room)
    want = Counter((r.doc_id, r.text, r.shard) for r in placed.collect())
    kept = {p: p.read_bytes() for s in (0, 1) for p in (tmp_path / "shards" / f"shard={s}").glob("*.parquet")} if room else {}
    for _ in range(2):  # a second call changes nothing
        sharding.rewrite(placed, folder)
        back = spark.read.parquet(folder).select("doc_id", "text", "shard").collect()
        assert Counter(map(tuple, back)) == want and len(back) == len(rows)
    assert all(p.read_bytes() == b for p, b in kept.items())


def test_rewrite_nothing_moved(spark, tmp_path):
    frame = spark.createDataFrame([(i, "x" * 9, "ab"[i % 2]) for i in range(20)], SCHEMA)
    placed = sharding.resharded(frame, "source", shards=2)
    assert not sharding.rewritten(placed).count()
    folder = str(tmp_path / "shards")
    placed.select("doc_id", "text", "shard").write.partitionBy("shard").parquet(folder)
    sharding.rewrite(placed, folder)
    assert spark.read.parquet(folder).count() == 20


# 5 licences


def test_licenses(spark, odd, empty):
    mit = license_scan.MIT
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.upper(), "mine"), (2, "MIT Licence\n" + mit.replace(",", ";").replace("\n", "  "), None), (3, mit[:-40], None), (4, "Text.\nReleased under the mit licence\nEnd.", None)]
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string, license string").selectExpr("*", "1 as digest")).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, ["MIT"])}
    assert {(r.license, tuple(r.notices)) for r in license_scan.scanned(odd).collect()} == {(None, ())} and license_scan.scanned(odd).count() == len(ODD)
    assert license_scan.scanned(empty).count() == 0


def test_license_canonical_forms(spark):
    from pyspark.sql import functions as F

    def plain(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        low = " " + re.sub("[^a-z0-9]+", " ", re.sub(license_scan.COPYRIGHT, " ", low)) + " "
        for a, b in license_scan.SPELLINGS:
            low = low.replace(f" {a} ", f" {b} ")
        return re.sub(" +", " ", low).strip(" ")

    texts = [t for _, t in license_scan.TEXTS + license_scan.NOTICES] + ["Copyright 1999-2001 X", "© Y\nBody", "copyright holder text", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", license_scan.canonical(F.col("t")).alias("c")).collect()
    assert all(r.c == plain(texts[r.i]) for r in got)


def test_license_long_texts(spark):
    """Every long text is found with other line breaks, a holder's line before it, and in upper case."""
    rng, rows = random.Random(5), []
    for i, (name, text) in enumerate(license_scan.long_texts()):
        body = re.sub(license_scan.COPYRIGHT, "", text, flags=re.I)  # a sample notice inside a text stays inside a line
        wrapped = re.sub(r"[ \n]++(?!(?:copyright(?=[ ,]+(?:\(c\)|year))|\(c\)|\u00a9|all rights reserved))", lambda m: rng.choice((" ", "\n", "\n * ")), body.replace("\n\n", "\n"), flags=re.I)
        rows += [(i, name, text), (i, name, f"Copyright 2020 Some One\n\n{text.upper()}"), (i, name, "Copyright The Foo Authors\n" + wrapped)]
    got = license_scan.scanned(spark.createDataFrame(rows, "i int, name string, text string")).collect()
    assert not [(r.i, r.name, r.license) for r in got if r.license != r.name]
    assert {r.name for r in got} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EPL-1.0", "CC0-1.0", "CC-BY-SA-4.0"}


@pytest.mark.parametrize("line", ["Copyright Jane Doe 2020", "Copyright The Foo Authors", "Portions Copyright (c) 2020 X", "Copyright (c) 2020 X", "// \u00a9 X", "(c) Jane Doe, 2020", "Parts of this file are copyright Bar Inc.", "Copyright: 2020, X"])
def test_license_holder_lines(spark, line):
    rows = [(1, f"{line}\n\n{license_scan.MIT}"), (2, f"MIT License\n\n# {line}\n{line.upper()}\n{license_scan.MIT}")]
    assert {r.license for r in license_scan.scanned(spark.createDataFrame(rows, "i int, text string")).collect()} == {"MIT"}


NOTICE_LINES = {
    'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.': ["Apache-2.0"],
    '# Licensed under the Apache License, Version 2.0 (the\n# "License"); you may not use this file except in\n# compliance with the License. You may obtain a copy of the License at\n#\n#   x': ["Apache-2.0"],
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * More": ["GPL-3.0"],
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": ["LGPL-2.1"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": ["MPL-2.0"],
    "// SPDX-License-Identifier: AGPL-3.0-or-later\nx": ["AGPL-3.0"], "SPDX-License-Identifier: EPL-2.0": ["EPL-2.0"], "Text is available under CC BY-SA 4.0.": ["CC-BY-SA-4.0"],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"], "Released under GPLv2+\nReleased under the BSD 3-Clause Licence.": ["BSD-3-Clause", "GPL-2.0"],
    "Published under CC0": ["CC0-1.0"], "It is licensed under some license\nMIT License\nCC BY 4.0": [],
}


def test_license_notices(spark):
    rows = list(enumerate(NOTICE_LINES))
    got = {r.i: r.notices for r in license_scan.scanned(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert {t: got[i] for i, t in rows} == NOTICE_LINES


# 6 main text


def test_main_text_of_given_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op6_html_extract(spark, FOLDER).collect():
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><p>Caf&eacute; &lt;b&gt; &#65;&amp;B<p>two\n\n words<br>x</article>", "Café <b> A&B two words x"),
        ("<nav><a href=x>One</a></nav><main><h1>Head</h1><div class='ad-box'>Buy the best of the things that you want</div><p>Yes</main><footer>Foot</footer>", "Head Yes"),
        ("<article><p>It is.</p><section id='comments'><p>I think that it is the best of all the texts that I have read.</p></section></article>", "It is."),
        ("<article><p>A<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style>B <!-- no --> C</p><form><p>Send</p></form></article>", "AB C"),
        ("<body><header>Menu</header><div><p>It was the best of times and it was the worst of times, and all that was in the city.</p><p>Short.</p></div><div class='cookie-notice'>We use cookies</div>", "It was the best of times and it was the worst of times, and all that was in the city. Short."),
        ("<html><head><title>T</title><body><article><p>Body of it</article>", "Body of it"),
        ("<article><p title=\"a > b\">In <b>bold</b>ly</p><p>cut <a hre", "In boldly cut"),
    ],
)
def test_main_text_cases(page, text):
    assert html_extract.main_text(page) == text


PROSE = ["It was the best of times and it was the worst of times, and all that was in the city.", "In the end they said that it was not for her to be with him or to see the sea."]
PARAS = "".join(f"<p>{p}</p>" for p in PROSE) + "<p>Short.</p>"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<body>{}</body>"])
@pytest.mark.parametrize(
    "attributes",
    ["class='overflow-hidden'", "aria-hidden='false'", "data-hidden='0'", "style='overflow:hidden'", "title='hidden'", "class='elementor-widget-container'", "class='post-header notice'", "class='notice'",
     "class='share-wrap'", "id='search-results'", "class='content-sidebar-wrap'", "class='category-comments'", "data-id='comment-1'", "class='sticky-footer'", "hidden=until-found"],
)
def test_main_text_wrappers(around, attributes):
    page = around.format(f"<div {attributes}>{PARAS}</div>")
    assert html_extract.main_text(page) == " ".join([*PROSE, "Short."])


@pytest.mark.parametrize(
    "attributes",
    ["hidden", "hidden=''", "aria-hidden=true", "style='display: none'", "class='x comments'", "id=sidebar", "class='main-menu'", "role='banner'", "class='entry-footer'", "class='ad-slot'", "class='cookie-banner'"],
)
def test_main_text_condemned(attributes):
    assert html_extract.main_text(f"<article><p>Text.</p><div {attributes}>{PARAS}</div></article>") == "Text."


def test_main_text_doubtful_places():
    page = f"<article>{PARAS}<div class='share'>Share this</div><div class='widget'><p>{PROSE[0]}</p><p>More</p></div></article>"
    assert html_extract.main_text(page) == " ".join([*PROSE, "Short.", PROSE[0], "More"])
    assert html_extract.main_text(f"<body class='ad-free comments-open'>{PARAS}") == " ".join([*PROSE, "Short."])
    assert html_extract.main_text("<div class=widget><article><p>Bit.</p></article></div>") == "Bit."


FOREIGN_PROSE = {
    "Russian": ["Вчера вечером в городе прошёл сильный дождь, и улицы старого центра оказались под водой. Жители рассказали, что такого ливня здесь не помнят уже много лет, а городские службы работали до самого утра, чтобы открыть движение.", "Сегодня днём вода начала уходить, и первые автобусы снова вышли на свои обычные маршруты."],
    "Greek": ["Χθες το βράδυ έπεσε δυνατή βροχή στην πόλη και οι δρόμοι του παλιού κέντρου γέμισαν νερό. Οι κάτοικοι είπαν πως τέτοια νεροποντή είχαν να δουν εδώ και πολλά χρόνια, ενώ τα συνεργεία δούλευαν μέχρι το πρωί.", "Σήμερα το μεσημέρι τα νερά υποχώρησαν και τα λεωφορεία βγήκαν πάλι στους δρόμους."],
    "Chinese": ["昨天晚上这座城市下了一场大雨,老城区的许多街道都被水淹没。当地居民说,他们已经很多年没有见过这样的暴雨,市政部门的工人一直工作到清晨,才让主要道路重新通车,学校也推迟了上课的时间。", "今天中午积水开始退去,第一批公共汽车重新回到了平时的路线上。"],
    "Japanese": ["昨日の夜、この町では激しい雨が降り、古い中心街の多くの道が水につかった。住民によると、このような大雨は何年も見たことがないという。市の職員は朝まで働き、ようやく主な道路の通行を再開させた。", "今日の昼ごろには水が引きはじめ、最初のバスがいつもの路線に戻った。"],
    "Polish": ["Wczoraj wieczorem nad miastem przeszła gwałtowna ulewa, przez którą ulice starego centrum znalazły się pod wodą. Mieszkańcy opowiadali, że takiego deszczu nie widziano tutaj od wielu lat, a służby miejskie pracowały aż do rana.", "Dzisiaj około południa woda zaczęła opadać, więc pierwsze autobusy wróciły na swoje trasy."],
    "Finnish": ["Eilen illalla kaupungissa satoi rankasti, ja vanhan keskustan kadut jäivät veden alle. Asukkaat kertoivat, ettei tällaista sadetta ole nähty täällä vuosiin, ja kaupungin työntekijät tekivät töitä aamuun asti teiden avaamiseksi.", "Tänään puolenpäivän aikaan vesi alkoi laskea, joten ensimmäiset bussit palasivat reiteilleen."],
}
LINK = "<div>" + "".join(f"<a href=/{i}>Ссылка на раздел {i} News</a> " for i in range(30)) + "</div>"


@pytest.mark.parametrize("language", sorted(FOREIGN_PROSE))
def test_main_text_other_languages(language):
    prose = FOREIGN_PROSE[language]
    body = "".join(f"<p>{p}</p>" for p in prose)
    for page in (f"<body>{LINK}<div>{body}</div>{LINK}", f"<body>{LINK}<p>Wikipedia</p>{LINK}<div>{body}</div>", f"<article>{body}{LINK}</article>", f"<div>{body}</div><div class=notice>We use cookies.</div>"):
        assert html_extract.main_text(page) == " ".join(prose)
    mixed = f"<body><p>{PROSE[0]}</p><p>{PROSE[1]}</p>{LINK}<div>{body}</div>"
    if language not in ("Polish", "Finnish"):  # next to another script
        assert html_extract.main_text(mixed) == " ".join([*PROSE, *prose])


def test_main_text_known_language_still_needs_stop_words():
    tags = "<p>" + "camera lens tripod flash battery " * 8 + "</p>"
    assert html_extract.main_text(f"<body>{PARAS * 3}{LINK}{tags}") == " ".join([*PROSE, "Short."] * 3)


def test_main_text_frame(spark):
    frame = spark.createDataFrame([(1, None, "u"), (2, "<article>a  b</article>", None), (2, "<article>a  b</article>", None)], "page_id int, html string, text string")
    got = html_extract.extracted(frame)
    assert got.columns == ["page_id", "text", "n_chars"] and sorted(map(tuple, got.collect())) == [(1, "", 0), (2, "a b", 3), (2, "a b", 3)]
    assert html_extract.extracted(frame.limit(0)).count() == 0


# 7 repeated passages


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 50))]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_dedup.suffix_order(np.array(s))[order].tolist() == list(range(len(s)))


def cut_passages(texts):
    n = suffix_dedup.WINDOW
    count, out = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)), []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = 1
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 1: every mixed core is counted window by window
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    a, b = piece(900), piece(390)
    texts = [a, a[:500] + piece(50), piece(40) + a[200:820] + piece(30) + a[100:560], "ab" * 500, "x" * 399, "x" * 400, "x" * 401, b + piece(9), b + piece(9), piece(60) + a + b, a, None, "", piece(700)]
    texts += [a[i : i + 470] + piece(20) for i in range(0, 300, 11)]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(5, "x" * 400), (70, "z" * 450)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "'no' as found")
    got = suffix_dedup.digest(suffix_dedup.removed(frame)).collect()
    want = cut_passages([(t or "").encode() for _, t in rows])
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_suffix_dedup_empty(empty, spark):
    assert suffix_dedup.removed(empty).count() == 0


def test_suffix_dedup_given(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = {(i, *w) for (i, _), w in zip(rows, cut_passages([t for _, t in rows]))}
    assert {tuple(r) for r in queries.op7_suffix_dedup(spark, FOLDER).collect()} == want


# 8 quality rules


def test_quality_cleaning(spark, empty, odd):
    prose = "This is a line of plain text that ends well, as it should do here.\n" * 1 + "And here is another one, with other words in it, that also ends as it must do.\n"
    rows = [(1, prose + "Home | About | Contact | Login\nBy using this site you accept our cookie policy\nmenu\n\nLast line that is long enough to stay in."), (2, "a | b | c | d | e | f | " * 9), (3, prose)]
    frame = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "length(text) n_chars", "true as kept", "1 as measures")
    got = {r.doc_id: r for r in quality.clean(frame).collect()}
    assert quality.clean(frame).columns == frame.columns and set(got) == {1, 3}
    assert got[1].text == prose + "\nLast line that is long enough to stay in." and got[1].n_chars == len(got[1].text) and got[3].text == prose
    bad = quality.judged(odd).collect()
    assert len(bad) == len(ODD) and all(r.n_words == len(words(r.text)) and (r.n_words >= 20 or not r.kept) for r in bad)
    assert quality.judged(empty).count() == 0 and quality.clean(empty).count() == 0


# 9 near duplicates


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_brute_force(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base = [], [fresh(120) for _ in range(3)]
    for i in range(90):  # copies of three texts, each with its own edits: many links, and some that just fail
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((i + 10, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)))
    chain = fresh(100)
    rows += [(200 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(10)]  # a chain: each is close to the next alone
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE two"), (304, "  "), (305, " ".join(base[0])), (306, " ".join(base[0]))]
    want = jaccard_components(rows)
    frame = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string").selectExpr("*", "1 as n", "'x' as component_id", "'y' as kept")
    got = minhash.labelled(frame).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == ((*want[r.doc_id], want[r.doc_id][1] == r.doc_id) if r.doc_id is not None else (1, None, True))
    kept = minhash.deduplicated(frame)
    assert kept.columns == frame.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, *(i for i, (_, c) in want.items() if c == i)])


def test_minhash_empty(empty):
    assert minhash.labelled(empty).count() == 0 and minhash.deduplicated(empty).count() == 0


def test_minmax_estimates():
    a, b = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64)), np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64)
    same = (minhash.signature(a) == minhash.signature(np.unique(np.r_[a[1000:], b]))).mean()
    assert abs(same - 0.6) < 0.15


# 10 packing


def test_word_encoder():
    from tokenizers import Tokenizer

    encode, tokenizer = packing.WordEncoder(queries.vocabulary()).encode, Tokenizer.from_file(queries.vocabulary())
    rng, letters = random.Random(6), "aZ é'sSßÀÿ²½9_-.İſ\t\n\xa0\x85{}~ŸɄ$%|ªµ\xad\x01\x7f中̇<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [f"a{chr(c)}b '{chr(c)}" for c in range(0x250)] + ["<|endoftext|> x"]
    assert all(np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("task_items", [packing.TASK_ITEMS, 7])
def test_packing(spark, monkeypatch, task_items):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "TASK_ITEMS", task_items)
    rows = ODD[:10] + [(100 + i, "word " * (37 * i), None) for i in range(60)] + [(500, "many words here " * 4000, None)]
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t, _ in rows]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as bin", "2 as piece").repartition(4)
    got = packing.packed(frame, queries.vocabulary(), with_ids=True).toPandas()
    want = Counter((i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for (i, _, _), x in zip(rows, ids) for k in range(0, len(x), 4096))
    assert Counter((None if r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert all(len(r.ids) == 4 * r.length for r in got.itertuples())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    if task_items == packing.TASK_ITEMS:
        assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 4096) + 1


def test_packing_empty(empty):
    assert packing.packed(empty, queries.vocabulary()).count() == 0


def test_best_fit():
    bins = packing.best_fit([5, 4, 3, 3, 2, 2, 1], 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) == 2


# pipeline


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."
    rows = [(i, prose(60 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)] + [(200 + i, rows[i][1] + " Also here.", "en", "s1", 1) for i in range(5)]
    rows += [(300, "too short", "en", "s0", 1), (301, None, None, None, None), (302, "menu\n" + prose(30), "en", None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(stage(spark, frame, FOLDER).toPandas(), stage(spark, frame, FOLDER).schema)
        out[name] = frame.collect()
        assert name == "pack" or frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(out) == ["quality_rules", "exact_duplicates", "near_duplicates", "mix_sources", "pack"]
    clean = {i: (t or "").removeprefix("menu\n") for i, t, *_ in rows if len(words(t)) >= 20}
    assert {r.doc_id: r.text for r in out["quality_rules"]} == clean and all(r.n_chars == len(r.text) for r in out["quality_rules"])
    assert {r.doc_id for r in out["exact_duplicates"]} == {min(ids) for ids in exact_groups(clean.items()).values()}
    want = jaccard_components([(r.doc_id, r.text) for r in out["exact_duplicates"]])
    left = {i for i, (_, c) in want.items() if c == i}
    assert {r.doc_id for r in out["near_duplicates"]} == left and len(left) == 41
    sizes, drawn = defaultdict(int), defaultdict(int)
    for r in out["near_duplicates"]:
        sizes[r.source] += len(words(r.text))
    for r in out["mix_sources"]:
        drawn[r.source] += len(words(r.text))
        assert r.text in clean[r.doc_id]
    assert all(abs(drawn[s] - t) < 0.01 * t + 2 for s, t in fair_targets(sizes).items())
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    ids = [np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in out["mix_sources"]]
    assert Counter((r.length, r.ids_crc32) for r in out["pack"]) == Counter((len(x), zlib.crc32(x.tobytes())) for x in ids)
    assert len({r.sequence_id for r in out["pack"]}) <= -(-sum(map(len, ids)) // 4096) + 1 and corpus_pipeline.ORACLE_SQL is None
