"""Each operator against brute force, on small tables with awkward rows."""

from __future__ import annotations

import gzip
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha1, sha256

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bpe, chat, common, components, hnsw, jaccard, packing, quality, rans, segments, spotsigs, toxicity, warc
from loomgraph.llm.queries import BYTE_BPE, BYTE_RANKS, WORD_BPE

#: Extra columns whose names the operators use inside.
EXTRA = "id long, n long, key string, label int, score double, component long, slice int, k long, u long"


def documents(spark, rows, extra=True):
    schema = "doc_id long, text string" + f", {EXTRA}" * extra
    return spark.createDataFrame([(i, t, *[None] * 9 * extra) for i, t in rows], schema)


def vocabulary(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward():
    rng, words = random.Random(1), vocabulary(400)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(1, 120))) for i in range(10, 60)]
    base = say(100).split()
    for i in range(60, 75):  # near copies
        own = list(base)
        own[rng.randrange(100)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(80, rows[0][1]), (81, rows[0][1].upper()), (82, rows[1][1]), rows[2], rows[2]]
    rows += [(90, None), (91, ""), (92, " \t\n"), (93, "one"), (94, "one"), (95, say(30_000)), (96, "Naïve café №5 ĳ ﬁ 😀 'tis <|endoftext|> x's don't\x00 İ"), (97, "é" * 5000), (None, say(20)), (None, None)]
    return rows


# ------------------------------------------------------------------ components
def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (None, 1), (2, 1)] + [(i, i + 1) for i in range(100, 140)], "u long, v long")
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} | dict.fromkeys(range(100, 141), 100)
    assert components.connected_components(edges.limit(0)).count() == 0


# --------------------------------------------------------------------- jaccard
def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_jaccard(spark, awkward):
    got = jaccard.jaccard_components(documents(spark, awkward))
    assert sorted(map(tuple, got.collect()), key=str) == brute_jaccard(awkward)
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(documents(spark, []), threshold=50)


def test_jaccard_chains_and_shared_passages(spark):
    """Chains of near copies whose ends don't link, and passages that hundreds share."""
    rng, words = random.Random(5), vocabulary(3000, 8)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = say(60), []
    for g in range(12):
        own = say(150)
        for k in range(12):
            own = list(own)
            for _ in range(2):
                own[rng.randrange(150)] = rng.choice(words)
            rows.append((1000 * g + k, " ".join(own)))
    rows += [(20_000 + i, " ".join(passage + say(rng.randint(2, 60)))) for i in range(250)]
    got = jaccard.jaccard_components(documents(spark, rows, extra=False))
    assert sorted(map(tuple, got.collect()), key=str) == brute_jaccard(rows)


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(0)
    sets = [frozenset(rng.integers(0, 60, rng.integers(5, 40)).tolist()) for _ in range(120)]
    counts = np.stack([np.bincount(np.array(sorted(s)) % 16, minlength=16) for s in sets]).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(sizes, counts)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t)}
        assert want <= set(tree.search(sizes[i], counts[i], 80).tolist())
    # Three levels of boxes, and next to nothing but the links comes out of them.
    sets = [frozenset((1000 * (k // 4) + j) * 7919 % 100_003 for j in range(k % 4, 60)) for k in range(600)]
    counts = np.stack([np.bincount(np.array(sorted(s)) % 256, minlength=256) for s in sets]).astype(np.uint32)
    tree = jaccard.CountTree(np.array([len(s) for s in sets]), counts)
    assert len(tree.levels) == 4
    found = 0
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t)}
        got = set(tree.search(len(s), counts[i], 80).tolist())
        assert want <= got
        found += len(got) - len(want)
    assert found < 600
    assert len(jaccard.CountTree(np.zeros(0, int), np.zeros((0, 16), np.uint32)).search(5, np.zeros(16), 80)) == 0


def test_tree_pairs_of_split_cells(spark, monkeypatch):
    """Cells of many blocks and sizes: the same pairs as of one block."""
    rng, words = random.Random(3), vocabulary(2000, 9)
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(90):
        own = list(base[: rng.choice([40, 60, 100, 105, 300])])
        for _ in range(rng.choice([0, 1, 3])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    sets = jaccard.shingle_sets(*spotsigs._flat([t for _, t in rows]))
    points = spark.createDataFrame([(i, bytearray(jaccard.count_vector(s))) for i, s in enumerate(sets)], "id long, counts binary")
    met = spark.createDataFrame([(5, i, len(s), i) for i, s in enumerate(sets)], "key long, id long, n long, component long")
    pairs = lambda: {(r.u, r.v) for r in jaccard.tree_candidates(points, met, 80).collect()}
    whole = pairs()
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    assert pairs() == whole
    want = {(a, b) for a in range(90) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert want <= whole and len(want) > 300
    every = spark.createDataFrame([(a, b) for a in range(90) for b in range(a)], "u long, v long")
    left = {(r.u, r.v) for r in jaccard.bounded(every, points, 80).collect()}
    assert want <= left and len(left) < 4005
    many = np.arange(300_000, dtype=np.uint64)
    assert len(jaccard.count_vector(many)) == 4 * jaccard.GROUPS and jaccard._points(pa.array([jaccard.count_vector(many)])).sum() == 300_000


# -------------------------------------------------------------------- spotsigs
def test_spotsigs(spark, awkward):
    rows = [r for r in awkward if r[0] is not None and r != awkward[2]] + [awkward[2]]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(order)
    prints = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert spotsigs.edited_fingerprints(documents(spark, [])).count() == 0
    assert spotsigs.edited_fingerprints(documents(spark, [(None, None), (None, "a b"), (3, "x")])).count() == 3
    one = spotsigs.edited_fingerprints(documents(spark, [(3, "the old house stands near the dark water")])).first()
    assert one.near_next == 1


def test_spotsigs_pairs(spark, awkward):
    prints = spotsigs.fingerprints(documents(spark, awkward))
    got = {(r.u, r.v) for r in spotsigs.similar_documents(prints).collect()}
    sets = {}
    for r in prints.where("id is not null and n_signatures > 0").orderBy("id").collect():
        sets.setdefault(r.fingerprint, (r.id, r.n_signatures, set(r.signatures)))
    small = [x for x in sets.values() if x[1] <= spotsigs.SKETCH]
    want = {(max(a[0], b[0]), min(a[0], b[0])) for a in small for b in small if a[0] != b[0] and len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])}
    assert want <= got and len(want) > 20


def brute_signatures(text):
    """A text's signatures as plain tuples: chains after anchors, chains at every word."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", low)
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        after = [k for k in content if k > i]
        if w in spotsigs.ANCHORS and len(after) >= spotsigs.CHAIN:
            out.add(("anchor", w, *(words[k] for k in after[: spotsigs.CHAIN])))
        if i + spotsigs.CHAIN < len(words):
            out.add(("plain", *words[i : i + spotsigs.CHAIN + 1]))
    return out | ({("whole", *words)} if 0 < len(words) <= spotsigs.CHAIN else set())


def test_spotsigs_against_brute_force(spark, awkward):
    rng, words = random.Random(6), vocabulary(60, 5) + spotsigs.ANCHORS
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 90]))) for _ in range(60)] + ["The DOG, the dog; the-dog", "ÉtÉ été", "a b", "the of"]
    texts += [t for i, t in awkward if i is not None and i < 70]
    sets = spotsigs.signature_sets(*spotsigs._flat(texts))
    brute = [brute_signatures(t) for t in texts]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    small = [k for k in range(len(texts)) if len(brute[k]) <= spotsigs.SKETCH]
    for a in small:
        for b in small:
            union = brute[a] | brute[b]
            want = len(brute[a] & brute[b]) / len(union) if brute[a] and brute[b] else float(not brute[a] and not brute[b])
            assert abs(spotsigs.likeness(sets[a], sets[b]) - want) < 1e-12
            assert spotsigs.likeness(sets[a], sets[b], 0.8) == (want if want >= 0.8 or spotsigs.likeness(sets[a], sets[b], 0.8) else 0.0)
    # Larger sets are estimated from the smallest hashes of the union.
    long = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(2)]
    half = " ".join(long[0].split()[:1500] + long[1].split()[:1500])
    x, y = spotsigs.signature_sets(*spotsigs._flat([long[0], half]))
    bx, by = brute_signatures(long[0]), brute_signatures(half)
    assert abs(spotsigs.likeness(x, y) - len(bx & by) / len(bx | by)) < 0.1
    # The query's own likeness is that of its fingerprints.
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(documents(spark, rows)).collect()}
    for i, t in rows:
        nxt = texts[i - 1] if i else texts[-1]
        k = len(t) // 3
        for field, other in (("near_next", nxt), ("near_edited", t[: len(t) - k] + nxt[:k])):
            p, q = brute_signatures(t), brute_signatures(other)
            want = len(p & q) / len(p | q) if p and q else float(not p and not q)
            if len(p) <= spotsigs.SKETCH and len(q) <= spotsigs.SKETCH:
                assert abs(getattr(got[i], field) - want) < 1e-12


def test_spotsigs_have_one_rule_for_all_lengths():
    words = vocabulary(400, 8)
    sets = lambda *texts: spotsigs.signature_sets(*spotsigs._flat(list(texts)))
    # Near copies on either side of 40 words, and a long text that gains its only anchor chain.
    text = [w for i in range(30) for w in ([words[i]] if i % 3 else ["the", words[i]])]
    a, b = sets(" ".join(text[:39]), " ".join(text[:39] + words[50:52]))
    assert spotsigs.likeness(a, b) > 0.8
    a, b = sets(" ".join(words[:300]), " ".join([*words[:150], "the", *words[150:300]]))
    assert spotsigs.likeness(a, b) > 0.9


# ------------------------------------------------------------------------ hnsw
def test_hnsw(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 24))
    rows = [(i, (centre[i % 40] + rng.normal(size=24) * rng.choice([0.05, 0.3, 3.0])).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(50)]  # copies
    bad = [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] * 24), (3004, []), (3005, [float("inf")] + [1.0] * 23)]
    rows += [(3006, [1e308] * 24), (3007, [1e-308] * 24), (3008, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows + bad + [(None, [1.0])]], "vec_id long, embedding array<double>, n long, id long")
    got = {r.vec_id: r for r in hnsw.dedup_vectors(frame).collect()}
    assert len(got) == len(rows) + len(bad) + 1
    full = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if len(v) == 24]
    unit = np.stack([v / np.sqrt(v @ v) for _, v in full])
    cos = unit @ unit.T
    near = cos >= 0.9
    np.fill_diagonal(near, False)
    # Every link is found here, and counted on both sides.
    assert [got[i].n_links for i, _ in full] == near.sum(1).tolist()
    root = np.arange(len(full))
    while (new := np.where(near, root[None], root[:, None]).min(1)).tolist() != root.tolist():
        root = np.minimum(new, root)
    assert [got[i].component_id for i, _ in full] == [full[k][0] for k in root]
    assert all(r.kept == (r.component_id == r.vec_id) for i, r in got.items() if i is not None)
    for i, _ in bad:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[3008].n_links == 0 and got[None].n_links == 0
    assert all(got[2000 + i].component_id == got[0].component_id and got[2000 + i].n_links == got[0].n_links for i in range(50))
    assert hnsw.dedup_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("partners", [0, 60, 3000])
def test_hnsw_audits_hold_links_on_sparse_and_dense_data(partners):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    q = np.concatenate([x[:partners] + 0.01 * rng.normal(size=(partners, 16)), rng.normal(size=(3000, 16))])
    shard = hnsw.ShardIndex(np.arange(6000), x)
    unit = hnsw._unit(q)
    want = int((unit @ hnsw._unit(x).T >= 0.95).sum())
    got = list(shard.links(unit, 0.95))
    seen, found = sum(g[2] for g in got), sum(len(g[0]) for g in got)
    assert seen >= hnsw.PLANTED and sum(g[3] for g in got) >= 0.98 * seen
    assert 0.99 * want <= found <= want
    one = hnsw.ShardIndex(np.arange(3), np.array([[1.0], [2.0], [-1.0]]))
    assert sorted((int(a), int(b)) for g in one.links(hnsw._unit(one.vectors), 0.9, one.ids) for a, b in zip(g[0], g[1], strict=True)) == [(1, 0)]


def test_hnsw_holds_no_group_at_once(monkeypatch):
    monkeypatch.setattr(hnsw, "CELLS", 60_000)
    rng = np.random.default_rng(9)
    x = np.concatenate([1 + 0.01 * rng.normal(size=(1000, 16)), rng.normal(size=(1000, 16))])
    shard = hnsw.ShardIndex(np.arange(2000), x)
    unit = hnsw._unit(x)
    got = list(shard.links(unit, 0.9, np.arange(2000)))
    want = (int((unit @ unit.T >= 0.9).sum()) - 2000) // 2
    assert want > 450_000 and 0.99 * want <= sum(len(g[0]) for g in got) <= want
    assert max(len(g[0]) for g in got) <= hnsw.CELLS


# --------------------------------------------------------------- tokens: 6,8,9
def encoded(path, texts):
    return [e.ids for e in segments.library_tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_packing(spark, awkward):
    rows = awkward
    want = defaultdict(list)
    for (i, _), ids in zip(rows, encoded(BYTE_BPE, [t for _, t in rows]), strict=True):
        want[i].append([*ids, 0])
    got = packing.pack_documents(documents(spark, rows), BYTE_BPE, BYTE_RANKS).collect()
    spans, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length, r.padded_length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, texts in want.items():
        pieces = sorted((at, min(1024, len(t) - at), zlib.crc32(raw(t[at : at + 1024])), len(t)) for t in texts for at in range(0, len(t), 1024))
        assert sorted(by_doc[i]) == pieces
    total = 0
    for own in spans.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and {p for _, _, p in own} == {1024 if at & (at - 1) else at}
        total += own[0][2]
    assert sorted(spans) == list(range(len(spans)))
    assert total <= 1.1 * sum(r.length for r in got) + 1024
    assert packing.pack_documents(documents(spark, []), BYTE_BPE, BYTE_RANKS).count() == 0


def test_packing_plan_places_every_rank_once():
    plan = packing.plan_packing({1024: 3, 700: 5, 300: 9, 24: 100, 1: 7})
    assert plan.sequences >= -(-(3 * 1024 + 5 * 700 + 9 * 300 + 2400 + 7) // 1024)
    assert (plan.used <= 1024).all() and packing.plan_packing({}).sequences == 0


def test_token_files(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    got = rans.round_trip(documents(spark, rows), WORD_BPE).collect()
    want, at = [], 0
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for (i, _), ids in zip(order, encoded(WORD_BPE, [t for _, t in order]), strict=True):
        want.append((i, at, len(ids) + 1, zlib.crc32(raw([*ids, 1]))))
        at += len(ids) + 1
    assert sorted(map(tuple, got)) == sorted(want)
    assert rans.round_trip(documents(spark, []), WORD_BPE).count() == 0
    assert rans.round_trip(documents(spark, awkward), WORD_BPE).count() == len(awkward)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 32_768, 70_001])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype("<u4")
    file = rans.TokenFile(rans.encode(ids, np.array([5]), np.array([n])))
    assert (file.decode() == ids).all() and file.lengths.tolist() == [n]
    assert (file.decode(file.blocks - 1) == ids[(file.blocks - 1) * rans.BLOCK :]).all()


def test_rans_finds_damage():
    ids = (np.random.default_rng(1).zipf(1.3, 5000) % 900).astype("<u4")
    blob = bytearray(rans.encode(ids, np.array([1]), np.array([5000])))
    blob[-40] ^= 1
    with pytest.raises(ValueError):
        rans.TokenFile(bytes(blob)).decode()
    with pytest.raises(ValueError):
        rans.TokenFile(b"x" * 40)


def test_files_follow_numbers_not_letters(spark):
    names = spark.createDataFrame([(f"s/part-{p:05d}-a-c{c:03d}.txt",) for p, c in ((2, 0), (1, 1000), (1, 999), (100_000, 0))], "file string")
    order = [r.file for r in names.orderBy(*rans.file_order()).collect()]
    assert [x.split("part-")[1] for x in order] == ["00001-a-c999.txt", "00001-a-c1000.txt", "00002-a-c000.txt", "100000-a-c000.txt"]


def test_bpe(spark, awkward):
    texts = [t or "" for _, t in awkward]
    library = segments.library_tokenizer(WORD_BPE)
    got = bpe.encode_documents(documents(spark, awkward), WORD_BPE).collect()
    want = [(i, len(ids), sha256(raw(ids)).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for (i, _), ids in zip(awkward, encoded(WORD_BPE, texts), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(documents(spark, []), WORD_BPE).count() == 0


def test_bpe_odd_words():
    rng = random.Random(2)
    alphabet = "aeinrst'ABZ09.,!-_ éßçñİı中文😀́‍\t\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x" * 700, "ab" * 300, "<|startoftext|>", "a<|endoftext|>B", "<|endoftext", "THE<|", "antidisestablishmentarianism"]
    got = [np.frombuffer(a, "<u4").tolist() for a, _ in bpe.encoder(WORD_BPE).encode(texts)]
    assert got == encoded(WORD_BPE, texts)


# ------------------------------------------------------------------- WARC (10)
def brute_warc(rows):
    from base64 import b32encode

    holder = {}
    for i, _, h in rows:
        if i is not None:
            holder[h or ""] = max(holder.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = holder[h or ""] if i is not None and i < holder[h or ""] else None
        out.append((i, len(p), b32encode(sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_warc(spark):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 9000
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>") for i in range(40)]
    rows += [(50, None, None), (51, "x\r\ny", ""), (52, "u", big), (53, "u", big), (54, "u", big + "!"), (60, "u", big + "1"), (60, "u", big + "2"), (60, "u", big + "2"), (None, "u", big + "3"), (None, "u", big + "4"), (None, "u", None), (7, "again", "<p>0</p>")]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "page_id long, url string, html string, size int, sha1 string, holder int")
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=str) == brute_warc(rows)
    assert warc.round_trip(frame.limit(0)).count() == 0
    small = warc.round_trip(frame, min_bytes=100).where("payload_bytes < 100 and record_type = 'revisit'")
    assert small.count() == 0


def test_warc_payloads_and_loss(spark, tmp_path):
    html = "".join(random.Random(1).choice("abc<>é") for _ in range(120_000))
    frame = spark.createDataFrame([(1, "u", html), (2, "u", "x"), (2, "u", "x"), (1, "u", html)], "page_id long, url string, html string")
    warc.write_warc(frame, f"{tmp_path}/a")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, f"{tmp_path}/a", payloads=True).collect()}
    assert got == {1: html, 2: "x"}
    records = warc.read_records(spark, f"{tmp_path}/a")
    assert records.where("segment > 1").count() >= 3
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("part-*"))
    names = [h["warc-record-id"] for h, _ in warc.parse(text)]
    assert len(names) == len(set(names)) == records.count()
    with pytest.raises(Exception, match="segments missing"):
        warc.reassemble(records.where("segment <> 2")).collect()


# ----------------------------------------------------------------- chat (op 1)
def test_chat(spark):
    calls = spark.createDataFrame(
        [
            ("a", 1, 5, "t", {"x": "1", "s": "h\"i\n"}, ["b"], 0), ("b", 1, 7, "t", {"x": "no"}, [], 0), ("c", 1, 8, "t", {"x": "2", "zz": "1"}, ["a", "gone", None], 0),
            ("d", 2, 1, "u", None, None, 0), ("e", 2, 2, "t", {}, ["f"], 0), ("f", 2, 3, "t", {"x": "3"}, ["e"], 0), (None, 2, 4, "t", {}, [], 0), ("b", 1, 7, "t", {"x": "no"}, [], 0),
            ("g", 3, 9, None, {"x": "4"}, [], 0),
        ],
        "call_id string, conv_id long, position long, name string, arguments map<string,string>, depends_on array<string>, content int",
    )
    results = spark.createDataFrame([("a", 9, "ok", 1), ("a", 8, "first", 1), ("b", 6, "soon", 1), ("z", 3, None, 1), (None, 1, "x", 1), ("c", 10, "é/<", 1)], "call_id string, position long, content string, name int")
    schemas = spark.createDataFrame([("t", [("x", "integer", True, None), ("s", "string", False, 3)])], "tool string, params array<struct<arg string, kind string, required boolean, max_length int>>")
    rows = {r.call_id: r for r in chat.link_calls(calls, results, schemas).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a": "linked", "b": "early", "c": "linked", "d": "unanswered", "e": "cyclic", "f": "cyclic", "g": "unanswered", "z": "orphan"}
    assert {k: r.errors for k, r in rows.items()} == {"a": "length:s", "b": "type:x", "c": "unknown:zz", "d": "unknown tool", "e": "missing:x", "f": "", "g": "unknown tool", "z": ""}
    assert rows["a"].message == '{"arguments":{"s":"h\\"i\\n","x":"1"},"call_id":"a","name":"t","result":"first","status":"linked"}'
    order = sorted(rows.values(), key=lambda r: (r.order_at, r.order_hops, r.position, r.call_id))
    at = {r.call_id: k for k, r in enumerate(order)}
    assert at["b"] < at["a"] < at["c"]
    assert chat.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_chat_query_orders_late_and_cyclic_calls(spark):
    """Derived calls against their order told one by one."""
    rng, rows = random.Random(4), []
    for c in range(60):
        lead = c % 4 == 0
        rows += [(c, 0, "system", "be brief")] if lead else []
        for k in range(rng.randint(1, 5)):
            t = 2 * k + lead
            rows += [(c, t, "user", "x" * rng.choice([10, 900])), (c, t + 1, "assistant", "ok")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in chat.link_calls(*chat.conversation_calls(turns)).collect()}
    asked = {(c, t): (t + 1 if r == "system" else t + 2 if len(x) > chat.LONG_PROMPT else t - 2) for c, t, r, x in rows if r != "assistant"}
    status = {r.status for r in got.values()}
    for (c, t), dep in asked.items():
        cyclic = lambda t, d: (c, d) in asked and asked[c, d] == t
        at, hops, d = t, 0, dep
        while d > at and (c, d) in asked and not cyclic(at, d):
            at, hops, d = d, hops + 1, asked[c, d]
        r = got[f"{c}:{t}"]
        assert (r.order_at, r.order_hops, r.status == "cyclic") == (at, hops, cyclic(t, dep))
    assert {"linked", "cyclic"} <= status and max(r.order_hops for r in got.values()) >= 3


def test_chat_long_chain_against_the_order(spark):
    n = 40
    calls = spark.createDataFrame([(f"c{i}", 1, i, "t", {}, [f"c{i + 1}"]) for i in range(n)], "call_id string, conv_id long, position long, name string, arguments map<string,string>, depends_on array<string>")
    keys = {r.call_id: r for r in chat.topological_keys(calls).collect()}
    assert not any(r.cyclic for r in keys.values())
    order = sorted(range(n), key=lambda i: (keys[f"c{i}"].order_key.at, keys[f"c{i}"].order_key.hops))
    assert order == list(range(n - 1, -1, -1))


# ------------------------------------------------------------ classifiers: 2,7
def labelled(spark, good, bad, field):
    rng, words = random.Random(9), vocabulary(500, 4)
    rows, marks = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        one = i % 3 == 0
        rows.append((i, (bad if one else good)(rng, t)))
        marks.append((i, int(one) if field == "toxic" else int(not one)))
    rows += [(900, None), (901, ""), (None, "plain words here"), (5, rows[5][1])]
    labels = spark.createDataFrame([(i, m, m, "x") for i, m in marks] + [(None, 1, 1, "x"), (77, None, None, "x"), (12345, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    return rows, labels, dict(marks)


@pytest.mark.parametrize("field", ["quality", "toxic"])
def test_classifiers(spark, field):
    if field == "quality":
        rows, labels, truth = labelled(spark, lambda _, t: " ".join(t).capitalize() + ".", lambda r, t: "BUY NOW!!! | " * r.randint(3, 12) + " ".join(t[:5]), field)
        learn, score, folds, split = quality.learn_ranking, quality.score_documents, 4, 2
    else:
        rows, labels, truth = labelled(spark, lambda _, t: " ".join(t), lambda r, t: " ".join(t[:9] + [r.choice(["grumblefoot", "snorkwit", "snorkwt", "blatherskite"]) for _ in range(2)] + t[9:]), field)
        learn, score, folds, split = toxicity.learn_toxicity, toxicity.score_documents, 3, 1
    docs = documents(spark, rows)
    model = learn(docs, labels)
    got = score(docs, model, to="judged").select("doc_id", "judged").collect()
    assert len(got) == len(rows) and all(0 <= r.judged <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % folds == split]
    right = sum((r.judged >= 0.7) == bool(truth[r.doc_id]) for r in held)
    assert right >= 0.95 * len(held) > 50
    # Labels of held-out rows are never read.
    other = labels.selectExpr("doc_id", *(f"case when pmod(crc32(cast(doc_id as string)), {folds}) = {split} then 1 - {c} else {c} end as {c}" for c in ("quality", "toxic")))
    again = score(docs, learn(docs, other), to="judged").select("doc_id", "judged").collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    for table in (labels.limit(0), labels.where(f"{field} = 1")):
        assert score(docs, learn(docs, table), to="judged").count() == len(rows)
    assert score(docs.limit(0), learn(docs.limit(0), labels), to="judged").count() == 0


def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch):
    """Blocks of any size, with few rows of one class: all rows take part in sums and pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    label = (np.arange(500) % 50 != 0).astype(int)
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(500)], "doc_id long, label int, features array<double>")
    monkeypatch.setattr(quality, "BLOCK_ROWS", 20)
    blocks = quality._blocks(rows, {0: 10, 1: 490})
    got = blocks.collect()
    each = [(np.frombuffer(b.good, bool), np.frombuffer(b.own, bool)) for b in got]
    assert len(got) == 25 and sum(own.sum() for _, own in each) == 500 and all(0 < g.sum() < len(g) for g, _ in each)
    for b, (g, _) in zip(got, each, strict=True):
        won, lost = quality._pairs(b.block, g)
        assert set(won) == set(np.flatnonzero(g)) and set(lost) == set(np.flatnonzero(~g))
    total = quality._summed(blocks, lambda _k, x, _g, own: {"x": x[own].sum(0)})["x"]
    assert np.allclose(total, x.sum(0))
    cut, share = quality._cut(blocks, _First(), {0: 10, 1: 490})
    s = x[:, 0]
    gain = lambda c: (s[label == 1] >= c).mean() + (s[label == 0] < c).mean()
    assert gain(cut) >= max(gain(c) for c in s) - 0.02 and share == (s < cut).mean()


class _First:
    def __call__(self, x):
        return x[:, 0]


def test_quality_reads_rows_beyond_any_sample(spark):
    """25,000 labelled rows: the cut stands over all of them, not over the first 20,000."""
    docs = spark.range(25_000).selectExpr("id as doc_id", "repeat(if(id % 5 = 0, 'BUY | NOW! ', 'some plain words here '), cast(2 + id % 7 as int)) as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 5 = 0, 0, 1) as quality")
    fitted = quality.training_rows(labels, "quality", 2, 4)
    assert fitted.count() == labels.where("pmod(crc32(cast(doc_id as string)), 4) <> 2").count()
    ranking = quality.learn_ranking(docs, labels, split=2, folds=40_000)
    assert abs(ranking.quantile - 0.2) < 1e-3
    right = quality.score_documents(docs, ranking).where("(score >= 0.7) = (doc_id % 5 <> 0)").count()
    assert right == 25_000


def test_toxicity_tells_quotation_from_abuse():
    model = toxicity.LexiconAutomaton(["grumblefoot"], [True])
    memory = toxicity._Memory(model)
    read = lambda t: toxicity.hit_features(t, memory)[:2]
    assert read("you are a grumblefoot and worse")[0] > 0 == read("you are a grumblefoot and worse")[1]
    assert read('the word "grumblefoot" is old')[1] > 0 == read('the word "grumblefoot" is old')[0]
    assert read("a grumblfoot")[0] > 0 and read("a grumbler")[0] == 0


@pytest.mark.parametrize("text, quotes", [
    ("I don't like you grumblefoot and you can't stay", False), ("İİİ İİ the 'grumblefoot' of old", True), ("İİİİİİ you grumblefoot, \"no\"", False),
    ("they say «grumblefoot» here", True), ("« vieux grumblefoot »", True), ("er rief „du grumblefoot“ laut", True), ("“a grumblefoot” is what it is", True), ("»grumblefoot« steht da", True),
    ("he had \"this\" you grumblefoot \"that\"", False), ("a mark ' hangs, grumblefoot, and ' goes", False), ("my dogs' grumblefoot and cats' tails", False), ("`grumblefoot`", True), ("\"one two three four five six seven grumblefoot eight\"", False), ("grumblefoot", False),
])
def test_quotation_by_paired_marks(text, quotes):
    memory = toxicity._Memory(toxicity.LexiconAutomaton(["grumblefoot"], [True]))
    abuse, quoted = toxicity.hit_features(text, memory)[:2]
    assert (quoted > 0, abuse > 0) == (quotes, not quotes)


def test_scores_of_odd_tables(spark):
    """Clashing and odd column names, very long texts, and ties at the cut."""
    docs = spark.createDataFrame([(1, "word " * 200_000, 5.0, 1, 2), (2, None, 5.0, 1, 2), (2, None, 5.0, 1, 2)], "doc_id long, text string, score double, `a``b` int, `c.d` int")
    ranking = quality.Ranking(np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), np.zeros(len(quality.FEATURES)), 0.0, 0.5)
    for got in (quality.score_documents(docs, ranking), toxicity.score_documents(docs, toxicity.ToxicModel(["word"], [False])), toxicity.score_documents(docs, toxicity.ToxicModel(base=0.7), spans=True).drop("hits")):
        assert sorted(got.columns) == sorted(docs.columns)
        rows = got.collect()
        assert len(rows) == 3 and all(0 <= r.score <= 1 and r["a`b"] == 1 and r["c.d"] == 2 for r in rows)
    # All strengths tie at the cut: the score is 0.7, which is accepted.
    assert {r.score >= 0.7 for r in quality.score_documents(docs, ranking).collect()} == {True}


@pytest.mark.parametrize("word, hit", [("abcdef", 0), ("abcdf", 1), ("abcxef", 1), ("abcdxef", 1), ("xabcdef", 1), ("abdcef", None), ("abcd", None), ("bcdef", 1)])
def test_automaton(word, hit):
    got = toxicity.LexiconAutomaton(["abcdef"], [True]).match(word)
    assert (None if got is None else got[1]) == hit


def test_words_go_only_for_stems_that_stay(monkeypatch):
    counts = [("snor*", 100, 0), ("snorkwit", 95, 0), ("snorbel", 20, 0), ("grum*", 90, 0), ("grumble", 40, 0), ("grumpet", 50, 0)]
    assert set(toxicity.pick_terms(counts, 1000, 1000)) == {"snorkwit", "snorbel", "grum*"}
    # A stem beyond the bound doesn't take its words along.
    monkeypatch.setattr(toxicity, "MAX_TERMS", 2)
    assert set(toxicity.pick_terms([("grum*", 90, 9), ("grumble", 60, 0), ("grumpet", 70, 0), ("blather", 99, 0)], 1000, 1000)) == {"blather", "grum*"}
    assert set(toxicity.pick_terms([("grum*", 40, 4), ("grumble", 34, 0), ("mudwort", 31, 0), ("blather", 99, 0)], 1000, 1000)) == {"blather", "grumble"}


def test_stems_match_with_an_edit_and_by_window(spark):
    rng, words = random.Random(5), vocabulary(500, 4)
    ends = ["ing", "ed", "er", "ers", "ish", "ly"]
    rows = [(i, " ".join([rng.choice(words) for _ in range(40)] + (["grumble" + rng.choice(ends), "snor" + rng.choice(ends)] if i % 3 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(documents(spark, rows), labels)
    assert any(t.endswith("*") for t in model.terms)
    memory = toxicity._Memory(toxicity.LexiconAutomaton(model.terms, model.fuzzy))
    assert memory["grumbleing"][1] == 0 and memory["grxmbleing"][1] == 1 and memory["snxring"][1] == 1
    stem = toxicity._Memory(toxicity.LexiconAutomaton(["grumb*"], [True]))
    read = lambda t: toxicity.hit_features(t, stem)[3:5]
    assert read("you are a grumbler and worse")[0] > 0 == read("you are a grumbler and worse")[1]
    assert read('the word "grumbler" is old')[1] > 0 == read('the word "grumbler" is old')[0]


# --------------------------------------------------------------------- texts
def test_word_hashes_tell_words_apart():
    words = vocabulary(5000, 6)
    assert len(set(common.hash_words([w.encode() for w in set(words)]).tolist())) == len(set(words))


def test_long_words_with_one_polynomial_hash_differ():
    a = b"a"
    for _ in range(11):  # Thue-Morse words collide in every polynomial hash modulo 2**64
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    x, y = common.hash_words([a, b])
    assert x != y and (common.hash_words([a]) == common.hash_words([a])).all()
