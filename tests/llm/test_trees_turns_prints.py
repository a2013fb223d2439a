"""Merkle manifest, conversation repair and SimHash against brute force and planted edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from strayfield.llm import components, merkle, minhash, repair, simhash
from tests.llm.test_corpus import ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11 manifest


def tree_of(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each digest the siblings left and right of its way, level by level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for way, i in zip(ways, at):
            lo = i - i % 16
            way.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], ways


def manifest_of(rows: list[tuple]) -> list[tuple]:
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))

    def found(r):
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        return (r[0], r[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)), *r[2:]) if hit else r

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree_of([leaf(r) for r in g]) for g in groups]
    root, tops = tree_of([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(groups, trees, tops):
        for r, way in zip(g, ways):
            acc = leaf(found(r))
            for before, after in way + top:
                acc = sha(before + acc + after)
            out.append((r[0], leaf(r), subroot, root, sha("".join(b + a for b, a in way + top)), acc, acc == root))
    return sorted(out, key=repr)


def some_docs(rng: random.Random, sizes: dict) -> list[tuple]:
    rows = []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "Ab\n" * rng.randint(1, 9), f"no capitals {rng.random()}", f"Ünï Cap {rng.random()}"])
            rows.append((rng.randint(0, 10**6), text, rng.choice([None, "en", ""]), source, rng.choice([None, 5, 123456789012])))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17}, {None: 1, "": 16, "-": 2, "=": 1, "b": 300, "ä": 33}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_brute_force(spark, sizes):
    rows = some_docs(random.Random(len(sizes)), sizes)
    rows += [rows[0], (None, "Null id", None, rows[0][3], 1), (None, None, None, rows[0][3], None), (rows[0][0], "same Id", "en", rows[0][3], 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as g", "1 as at", "2 as n", "'y' as leaf", "'z' as s0", "'w' as way").repartition(3)
    got = merkle.manifest(df, altered=merkle.lower_cased(df)).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_of(rows)


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty, altered=merkle.lower_cased(empty)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(7, None, None, None, None)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == sha("1:7----") and one.verified and one.proof_sha256 == sha("")


# 12 conversations


def cheapest(rows: list[tuple[str, str]], must: list[bool], cut: list[bool]) -> tuple[int, str, list[str]]:
    """All edits by dynamic programming over whole strings."""
    role = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", [])}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for q, (c, audit, made) in list(best.items()):
                r = role[q]
                new = (c + 3, audit + "I", [*made, f"{r}:"])
                if r[0] not in best or new[:2] < best[r[0]][:2]:
                    best[r[0]] = new
        if i == len(rows):
            break
        following: dict = {}
        (r, text), extra = rows[i], 3 * cut[i]
        for q, (c, audit, made) in best.items():
            steps = [(q, c + 4, audit + "D", made)]
            if not must[i]:
                fits = role[q]
                if r[:1] == fits[0] or (r[:1] == "s" and q == ""):
                    steps.append((r[:1], c + extra, audit + "K", [*made, f"{r}:{text}"]))
                steps.append((fits[0], c + 3 + extra, audit + "R", [*made, f"{fits}:{text}"]))
            for to, *new in steps:
                if to not in following or tuple(new[:2]) < following[to][:2]:
                    following[to] = tuple(new)
        best = following
    return min((best[q] for q in ("", "a") if q in best), key=lambda x: x[:2])


def report_of(rows: list[tuple]) -> tuple:
    said = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    blank = [not re.search(r"[^\x20\x09-\x0D]", x) for _, _, x in said]
    dup = [not blank[i] and any(said[j][1:] == said[i][1:] for j in range(i)) for i in range(len(said))]
    cut = [not blank[i] and not dup[i] and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", said[i][2]) for i in range(len(said))]
    turns = [t for t, _, _ in said if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    cost, audit, made = cheapest([r[1:] for r in said], [b or d for b, d in zip(blank, dup)], cut)
    return gaps, sum(blank), sum(dup), sum(cut), illegal, cost, audit, sha("\n".join(made))


def some_turns(rng: random.Random, n: int) -> list[tuple]:
    texts = ["Yes.", "No!", "open end", "", " \n", None, "Why?  ", "a.b", "…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(rng.choice([None, i, i, i, i, i + 1, 2 * i]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Say {rng.randint(0, 10**6)}.") for i in range(n)]


def check_report(spark, convs: dict, **cuts):
    rows = [(c, *r) for c, turns in convs.items() for r in turns]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as g", "0 as pos", "1 as chunk", "'y' as fault").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert len(got) == len(convs)
    for c, turns in convs.items():
        assert got[c] == report_of(turns), c


def test_repair_brute_force(spark):
    rng = random.Random(5)
    check_report(spark, {c if c else None: some_turns(rng, rng.randint(1, 9)) for c in range(250)})


def test_repair_of_long_conversations(spark):
    rng = random.Random(6)
    convs = {1: some_turns(rng, 200), 2: some_turns(rng, 64), 3: some_turns(rng, 65), 4: [(i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(500)]}
    check_report(spark, convs)


def test_repair_in_several_levels(spark, monkeypatch):
    for name, value in (("CHUNK", 3), ("GROUP", 2)):
        monkeypatch.setattr(repair, name, value)
    rng = random.Random(7)
    check_report(spark, {c: some_turns(rng, n) for c, n in enumerate([1, 3, 4, 7, 12, 13, 25, 40, 61] * 4)})


def test_repaired_turns(spark):
    rng = random.Random(8)
    rows = [(c, *r) for c in range(30) for r in some_turns(rng, 6)]
    turns = repair.repaired(spark.createDataFrame(rows, TURNS)).collect()
    whole = {r.conv_id: r for r in repair.report(spark.createDataFrame(rows, TURNS)).collect()}
    for c in range(30):
        own = sorted((t for t in turns if t.conv_id == c), key=lambda t: t.at)
        assert [t.at for t in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own))
        assert sha("\n".join(f"{t.role}:{t.text}" for t in own)) == whole[c].repaired_sha256
        assert "".join(t.edit for t in own) == whole[c].audit.replace("D", "")


def test_auction_prices_are_exact_and_feasible():
    rng = random.Random(9)
    for _ in range(60):
        symbols = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randint(1, 14)))
        lattice = repair.Lattice(symbols, repair.row_arcs)
        arcs, price = lattice.priced(repair.END, range(repair.STATES))
        assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, _, j in out)
        rows = [({"x": "tool", "s": "system", "u": "user", "a": "assistant", "d": "user"}[s.lower()], "") for s in symbols]
        cost, audit, _ = cheapest(rows, [s == "d" for s in symbols], [s.isupper() for s in symbols])
        walked, spent, end = lattice.traced(arcs, price, 0)
        assert (price[0], spent + repair.END[end], walked + repair.CLOSING[end]) == (cost, cost, audit)


def test_damage_and_conversations_without_rows(spark):
    assert repair.report(spark.createDataFrame([], TURNS)).collect() == []
    code = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = [(c, t, "assistant", "One. Two! Three? ") for c in (None, *range(60)) for t in (None, 1, 2)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as fault", "2 as copy")
    got = sorted(map(tuple, repair.damaged(df).select("conv_id", "turn", "role", "text").collect()), key=repr)
    want = []
    for c, t, r, x in rows:
        k = code(c, t)
        if k:
            want += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    assert got == sorted(want, key=repr) and {code(c, t) for c, t, *_ in rows} >= {0, 1, 2, 3, 4}
    lost = next(c for c in range(10**4) if code(c, 1) == 0)
    one = spark.createDataFrame([(lost, 1, "user", "Hi.")], TURNS)
    assert tuple(repair.report(repair.damaged(one), ids=one).first()) == (lost, 0, 0, 0, 0, 0, 0, "", sha(""))


# 13 fingerprints


def print_of(text: str | None) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints: list[int]) -> list[int]:
    """Number of the first row of each row's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.array(prints, np.uint64)
    for i, j in np.argwhere(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", "1 as fp", "2 as id", "3 as root")
    got = sorted(map(tuple, simhash.labelled(df).select("doc_id", "fingerprint").collect()), key=repr)
    assert got == sorted(((i, f"{print_of(t):016x}") for i, t, _ in ODD), key=repr)
    by = {r.doc_id: r.component_id for r in simhash.labelled(df).collect()}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[8] == by[6]
    assert simhash.labelled(df.where("false")).collect() == []
    assert [tuple(r) for r in simhash.labelled(spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()][0][2] is None


def test_fingerprint_of_a_long_text_in_passes(monkeypatch):
    text = " ".join(random.Random(1).choices(["Oak", "ash", "elm", "YEW", "fir", "ähre"], k=5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PASS", 7)
    assert simhash.fingerprint(text) == whole == print_of(text)


def test_real_texts_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    root = classes_of([print_of(r.text) for r in rows])
    want = {r.doc_id: (f"{print_of(r.text):016x}", rows[i].doc_id) for r, i in zip(rows, root)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.labelled(docs).collect()} == want


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_links_brute_force(spark, monkeypatch, block):
    """Chains, crowded buckets, flips in one half or both, at and over the limit."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(f)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
    crowd = rng.getrandbits(32)
    prints |= {crowd << 32 | rng.getrandbits(6) << 3 for _ in range(200)} | {crowd | rng.getrandbits(32) << 32 for _ in range(200)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(simhash.matches(simhash.blocks(df)))).collect()}
    want = classes_of([p % (1 << 64) for p in signed])
    assert [found.get(p, p) for p in signed] == [signed[i] for i in want]


def test_components_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5001 + i) for i in range(400)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# 9, compared in blocks


def test_shared_counts_leave_no_similar_pair_out():
    rng = np.random.default_rng(2)
    base = np.arange(300)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(150, 300), replace=False), rng.integers(1000, 9000, rng.integers(0, 120))])) for _ in range(60)]
    for a, b in ((sets[:25], sets[25:]), (sets, None)):
        x, y, both = minhash.shared_counts(a, b)
        counted = {(x[i], y[j]): both[i, j] for i in range(len(x)) for j in range(len(y))}
        for i, s in enumerate(a):
            for j, t in enumerate(a if b is None else b):
                n = len(np.intersect1d(s, t))
                if 100 * n >= 75 * (len(s) + len(t) - n) and (b is not None or i != j):
                    assert counted[i, j] == n


def test_crowded_bucket_of_edited_copies(spark, monkeypatch):
    """Two thousand edited copies of one text around the limit: classes as by brute force, in many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 1 << 15)
    rng = random.Random(11)
    text = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(60)]
    docs = []
    for i in range(2000):
        own = list(text)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5, 6])):
            own[k] = rng.choice(["x", f"y{rng.randint(0, 3)}", f"z{i}"])
        docs.append((i, " ".join(own)))
    sets = [minhash.shingles(t) for _, t in docs]
    x, y, both = minhash.shared_counts(sets, None)
    n = np.array([len(s) for s in sets])
    root = np.arange(len(docs))
    i, j = np.nonzero(100 * both >= 75 * (n[x][:, None] + n[y][None, :] - both))
    nodes, low = components.forest(x[i], y[j])
    root[nodes] = low
    got = {r.doc_id: r.component_id for r in minhash.labelled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    missed = [d for d in range(len(docs)) if got[d] != root[d]]
    assert 5 < len(set(root.tolist())) < 1900 and not missed
