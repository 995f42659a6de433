"""Exact dedup, token counts, packing, mixing, SimHash, quality, licenses: against brute force, on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tsledger.llm import common, components, exact_dedup, licenses, mixing, packing, quality, simhash, tokens  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, KEPT string, component_id long"
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have".split()


def corpus():
    """Nulls, empties, copies, near copies, ties, repeated rows, a hot source, a long text, odd white space."""
    rnd = random.Random(7)
    rows = []
    for k in range(150):
        text = " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randrange(1, 120)))
        rows.append((k, text, "en", rnd.choice(["a", "a", "a", "b", "c", None]), len(text)))
    long = " ".join(rnd.choice(WORDS) for _ in range(6000))
    base = " ".join(rnd.choice(WORDS) + str(k) for k in range(300))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n", "en", "zz", 3), (203, long, "en", "a", len(long)), (204, None, "en", "a", 0)]
    rows += [(300 + k, base, "en", "a", len(base)) for k in range(20)]
    rows += [(330 + k, base.replace("the", "thy", 1) if k % 2 else base + f" {k}", "en", "b", 1) for k in range(20)]
    rows += [(400, "One  two\tthree", "en", "a", 14), (401, "one two three", "en", "d", 13), (402, "One two three", "en", "a", 13), (402, "One two three", "en", "a", 13), (None, "One two three", "en", "a", 13)]
    rows += [(403, "naïve Ünïcode ΑΣ <|endoftext|> x's 123", "de", "e", 5), (404, "a\u00a0b\u2003c  d\r\n\r\n e\x1cf", "de", "e", 5), (405, "😀 👩‍👩‍👧 중국", "xx", "𐀀", 3), (406, "x", "xx", "\uffff", 1)]
    return [(*r, 0.5, "no", 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- exact dedup


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = rnd.integers(0, 2**63, (n, 4)).astype("<u8")
        t = exact_dedup.PerfectHash.build(keys)
        assert sorted(t.slots(keys)) == list(range(n)) == sorted(exact_dedup.PerfectHash.load(*t.dump()).slots(keys))
        other = rnd.integers(0, 2**63, (100, 4)).astype("<u8")
        assert ((t.slots(other) >= -1) & (t.slots(other) < max(n, 1))).all()
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(np.ones((2, 4), "<u8"))


@pytest.mark.parametrize("per", [4, 100_000])
def test_exact_dedup(docs, per):
    got = rows_of(exact_dedup.exact_dedup(docs, per))
    groups = defaultdict(list)
    for r in corpus():
        groups[normal(r[1])].append(r[0])
    assert len(got) == len(corpus()) and sum(r["kept"] for r in got) == len(groups)
    want = {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert {r["text_sha256"] for r in got} == set(want)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[r["text_sha256"]] and (not r["kept"] or r["doc_id"] == r["keep_id"])


def test_exact_dedup_keeps_rows(docs, none):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = Counter(normal(r.text) for r in kept.collect())
    assert set(got.values()) == {1} and set(got) == {normal(r[1]) for r in corpus()}
    assert rows_of(exact_dedup.exact_dedup(none)) == [] == rows_of(exact_dedup.keep_first(none))


def test_batches_against_a_stored_index(spark, docs, none, tmp_path):
    """A history and two later batches: repeats of the history, of the batch itself, new texts."""
    own = corpus()
    history, batch = own[::2], own[1::2] + own[:3]
    path = exact_dedup.store_index(spark.createDataFrame(history, SCHEMA), str(tmp_path / "index"), 8)
    of = lambda rows: {t: ([r[0] for r in rows if normal(r[1]) == t]) for t in {normal(r[1]) for r in rows}}
    old, new = of(history), of(batch)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    got = rows_of(exact_dedup.dedup_batch(spark.createDataFrame(batch, SCHEMA).repartition(3), path))
    name = {hashlib.sha256(t.encode()).hexdigest(): t for t in new}
    assert len(got) == len(batch)
    for r in got:
        t = name[r["text_sha256"]]
        assert r["group_size"] == len(old.get(t, [])) + len(new[t]) and r["keep_id"] == least(old.get(t) or new[t])
        assert not (r["kept"] and t in old)
    assert Counter(name[r["text_sha256"]] for r in got if r["kept"]) == Counter(t for t in new if t not in old)
    empty = exact_dedup.store_index(none, str(tmp_path / "empty"))
    assert sum(r["kept"] for r in rows_of(exact_dedup.dedup_batch(spark.createDataFrame(batch, SCHEMA), empty))) == len(new)
    assert rows_of(exact_dedup.dedup_batch(none, path)) == []


# ---- tokens and packing


def test_merging_pops_the_lowest_rank():
    ranks = {("a", "b"): 2, ("b", "c"): 0, ("a", "bc"): 1, ("x", "x"): 3, ("xx", "x"): 4}
    assert tokens.merges_of(list("abc"), ranks) == 2 and tokens.merges_of(list("ab"), ranks) == 1
    assert tokens.merges_of(list("xxxxx"), ranks) == 3 and tokens.merges_of(["a"], ranks) == 0


def odd_texts(n, seed):
    rnd = random.Random(seed)
    parts = list("abcABC  \n\t\x0b\x1c\x85\u3000'sSΣσςéÉİßꟊ中文123½ⅷ!?-…🙂") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'LL", "ΑΣ", " ", "   ", "\n\n", "é", "the", "한", "ᄒ", "ᅡ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(16))) for _ in range(n)]


def test_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.Counter(path)
    texts = odd_texts(4000, 1) + [r[1] or "" for r in corpus()]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_all_letters_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.Counter(path)
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x13500), *range(0x16000, 0x17000), *range(0x1E000, 0x20000), *range(0x2F800, 0x2FA20), 0x32808, 0x3E988] if c != 0x20]
    for form in ("a{0}B", "'{0}'s1", "{0}"):
        texts = [form.format("".join(points[k : k + n])) for n in (1, 7) for k in range(0, len(points), n)]
        got, want = [own.count(t) for t in texts], [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_token_counts(docs, none):
    got = rows_of(tokens.token_counts(docs, limit=100))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert rows_of(tokens.token_counts(none)) == []


def test_bounded_table():
    made = []
    t = common.Recent(lambda k: made.append(k) or k * 2, 3)
    for k in "abcdabcd":
        assert t[k] == k * 2
    assert len(t) <= 3 and made == ["a", "b", "c", "d"]


def test_identifiers_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.Tokens(path)
    assert own.ranked is not None
    for t in odd_texts(4000, 2) + [r[1] or "" for r in corpus()]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_cuts_and_best_fit():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(1024) == [(0, 1024)] and packing.cuts(2050) == [(0, 2), (2, 1024), (1026, 1024)]
    p = packing.BestFit(10, 2)
    closed = p.add("a", 6) + p.add("b", 7) + p.add("c", 3)  # c fills the fuller bin, b's
    assert closed == [(1, [("b", 0), ("c", 7)])]
    closed = p.add("d", 8) + p.add("e", 9)  # the fullest closes first
    assert closed == [(3, [("e", 0)])] and [n for n, _ in p.finish()] == [2, 0] and p.add("f", 10) == [(4, [("f", 0)])]


def test_online_packing_of_many_pieces(spark):
    """Close to the lower bound over many pieces that come in no order, in each partition and over all."""
    rnd = random.Random(9)
    lengths = [min(1024, max(1, int(rnd.lognormvariate(5, 1.2)))) for _ in range(20_000)]
    p, closed = packing.BestFit(1024, 2048), 0
    for k, n in enumerate(lengths):
        closed += len(p.add(k, n))
    assert closed + len(p.finish()) <= 1.02 * sum(lengths) / 1024 + 1
    rows = [(k, " ".join(rnd.choice(WORDS) for _ in range(int(min(1000, max(1, rnd.lognormvariate(5, 1.2))))))) for k in range(3000)]
    got = packing.pack_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    tokens_, sequences = got.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert sequences <= 1.03 * tokens_ / 1024 + 1


def test_packing(docs, none):
    got = rows_of(packing.pack_documents(docs))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in corpus():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.update((r[0], k, s, n, np.array(ids[s : s + n], "<u4").tobytes()) for k, (s, n) in enumerate(packing.cuts(len(ids))))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 1024
    free = []  # first fit, longest first, without a bound on open bins
    for n in sorted((r["length"] for r in got), reverse=True):
        at = next((k for k, f in enumerate(free) if f >= n), None)
        if at is None:
            free.append(1024 - n)
        else:
            free[at] -= n
    # a packer that must place each piece when it arrives may spend the small ones early; longer inputs are tested below
    assert len(bins) <= len(free) * 1.1 + 1
    crc = rows_of(packing.pack_digests(docs))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in crc) == Counter((r["doc_id"], r["piece"], zlib.crc32(bytes(r["ids"]))) for r in got)
    assert rows_of(packing.pack_documents(none)) == []


# ---- mixing


def water(sizes, share=1.5):
    """Targets by raising the level step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("per", [8, 1 << 20])
def test_mixing(docs, per):
    got = rows_of(mixing.mix(docs, range_rows=per))
    source = defaultdict(int)
    for r in corpus():
        source[r[3]] += len(words(r[1]))
    want = water(source)
    of = {r[0]: r[3] for r in corpus()}
    taken = defaultdict(int)
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == source[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(corpus()) and all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in source)
    again = rows_of(mixing.mix(docs.repartition(5), range_rows=16))
    key = lambda rows: sorted((repr(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)


def test_mixed_rows(docs, none):
    plan = {(r["doc_id"], r["size"]): r for r in rows_of(mixing.mix(docs))}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got, texts = Counter(), defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        texts[r.doc_id] += 1
    for (doc, size), r in plan.items():
        if [x[0] for x in corpus()].count(doc) == 1:
            assert got[doc] == r["taken"] and (size or texts[doc] == 1)
    assert rows_of(mixing.mix(none)) == [] == rows_of(mixing.apply_mix(none))


def test_mixed_rows_with_repeated_ids(spark):
    """Ids that repeat within and across sources, or are null, and columns with the operator's own names."""
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))), s, "p", 1, 2) for s in "abc" for k in range(40)]
    rows += [(1, " ".join(["same"] * 50), s, "p", 1, 2) for s in "abc" for _ in range(5)]
    rows += [(None, " ".join(["none"] * n), s, "p", 1, 2) for s in "ab" for n in (10, 10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __plan string, __row int, SIZE int").repartition(3)
    of = defaultdict(int)
    for r in rows:
        of[r[2]] += len(words(r[1]))
    want, got, times = water(of), defaultdict(int), Counter()
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
        times[(r.doc_id, r.text, r.source)] += 1
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-6 for s in of)
    there = Counter((r[0], r[1], r[2]) for r in rows)
    assert all(n <= 2 * there[k] for k, n in times.items() if k in there)


# ---- SimHash


def slow_fingerprint(text):
    ws = [w.decode() if isinstance(w, bytes) else w for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not ws:
        return 0
    grams = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=2):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(fps)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    return {f: root(f) for f in own}


@pytest.mark.parametrize("heavy", [1, 4096])
def test_simhash(docs, heavy):
    got = rows_of(simhash.simhash_dedup(docs, heavy=heavy))
    fps = [(r[0], slow_fingerprint(r[1])) for r in corpus()]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{f:016x}") for d, f in fps)
    of = slow_components({f for _, f in fps})
    least = {}
    for d, f in fps:
        if d is not None:
            least[of[f]] = min(least.get(of[f], d), d)
    for r in got:
        assert r["component_id"] == least[of[int(r["fingerprint"], 16)]]


@pytest.mark.parametrize("heavy, distance", [(2, 2), (4096, 2), (3, 4), (3, 1), (4096, 0)])
def test_chains_of_fingerprints(spark, heavy, distance):
    """Chains whose ends are far apart, dense balls, lone ones; null ids."""
    rnd = random.Random(3)
    fps = []
    for _ in range(6):
        f = rnd.getrandbits(64)
        for _ in range(25):
            fps.append(f)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])):
                f ^= 1 << b
    fps += [rnd.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, 2**63, 2**64 - 1]
    fps = list(dict.fromkeys(fps))
    rnd.shuffle(fps)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    prints = spark.createDataFrame([(k, signed(f)) for k, f in enumerate(fps)] + [(None, signed(fps[0])), (500, signed(fps[0]))], "doc_id long, fp long")
    got = {r.fp % 2**64: r.component for r in simhash.near_classes(prints, distance, heavy=heavy).collect()}
    of, least = slow_components(fps, distance), {}
    for k, f in enumerate(fps):
        least[of[f]] = min(least.get(of[f], k), k)
    assert got == {f: least[of[f]] for f in fps}


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_copies_go(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in rows_of(simhash.simhash_dedup(docs))}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert rows_of(simhash.simhash_dedup(none)) == [] == rows_of(simhash.keep_one(none))


def test_unrelated_rows_with_null_or_repeated_ids_stay(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(80)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(3, texts[0]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (None, texts[6]), (9, texts[7])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(frame).collect()]
    assert Counter(kept) == Counter([(3, texts[0]), *((None, t) for t in texts[1:4]), (7, texts[4]), (7, texts[5]), (None, texts[6]), (9, texts[7])])
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.simhash_dedup(frame)))
    least = {texts[0]: 3, texts[4]: 7, texts[5]: 7, texts[7]: 9}
    assert got == Counter((d, f"{slow_fingerprint(t):016x}", least.get(t)) for d, t in rows)


@pytest.mark.parametrize("together", [3, 2048])
def test_stage_links_all_similar_texts(spark, together):
    """Edited texts of all lengths, a common passage and a large group, against all pairs."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(WORDS) + str(rnd.randrange(40))
    passage, rows = [word() for _ in range(12)], []
    for n in [4, 5, 9, 20, 60, 150, 300] * 4:
        base = [word() for _ in range(n)] + passage * rnd.randrange(2)
        rows.append(base)
        for _ in range(rnd.choice([1, 3, 12])):
            edited = list(base)
            for _ in range(rnd.randrange(1, max(2, n // 30))):
                edited[rnd.randrange(len(edited))] = word()
            rows.append(edited + passage * rnd.randrange(2))
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    fps, root, far = [slow_fingerprint(t) for _, t in rows], list(range(len(rows))), 0
    for i in range(len(rows)):
        for k in range(i):
            alike = len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])
            far += alike and (fps[i] ^ fps[k]).bit_count() > 2
            if (alike or (fps[i] ^ fps[k]).bit_count() <= 2) and root[i] != root[k]:
                root = [min(root[i], root[k]) if x in (root[i], root[k]) else x for x in root]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), together=together).collect()
    assert far > 50 and sorted(r.doc_id for r in got) == sorted(set(root))


# ---- quality


def test_quality(spark, docs, none):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(20, 200))).capitalize() + "."
    bad = lambda: " ".join((rnd.choice(WORDS) + rnd.choice(["***", "$$$", "###"])) for _ in range(rnd.randrange(20, 200)))
    rows = [(k, good() if k % 4 else bad(), "en", "s", 1, 0.0, "", 0) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(5, None, 0), (None, 1, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(quality.classify(table, labels))
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert all(held[k] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(400))
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in got if r["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    # labels of the held-out fold change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality.classify(table, turned).orderBy("doc_id")) == sorted(got, key=lambda r: r["doc_id"])
    some = rows_of(quality.classify(docs, labels))
    assert len(some) == len(corpus()) and all(0 <= r["score"] <= 1 for r in some)
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    assert rows_of(quality.classify(none, labels)) == [] and rows_of(quality.classify(docs, labels.filter("false")))[0]["score"] == 0.5


def test_statistics_against_plain_counts():
    """Each statistic recounted one character, word and line at a time."""
    import math
    from string import ascii_lowercase, ascii_uppercase, digits

    def slow(text):
        space, marks = set(" \t\n\v\f\r"), set(".,;:'\"-?()")
        chars = [chr(b) for b in (text or "").encode()]
        solid = [c for c in chars if c not in space]
        symbol = lambda c: c not in ascii_lowercase + ascii_uppercase + digits and c not in space and ord(c) < 128 and c not in marks
        ws = "".join(" " if c in space else c for c in chars).split(" ")
        ws = [w for w in ws if w]
        lines = [x for x in "".join(chars).split("\n") if any(c not in space for c in x)]
        odds = lambda k, n: math.log((k + 0.5) / (max(n - k, 0) + 0.5))
        times = lambda xs: max((xs.count(x) for x in xs), default=0)
        share = [solid.count(c) / len(solid) for c in set(solid)]
        pairs = list(zip(ws, ws[1:]))
        return [
            math.log(1 + len(ws)), math.log(1 + len(solid) / max(len(ws), 1)), odds(sum(c in ascii_uppercase for c in chars), sum(c in ascii_uppercase + ascii_lowercase for c in chars)),
            odds(sum(c in digits for c in chars), len(solid)), odds(sum(map(symbol, chars)), len(solid)), odds(sum(c in marks for c in chars), len(solid)),
            -sum(p * math.log(p) for p in share), odds(len(set(ws)), len(ws)), odds(times(ws), len(ws)), odds(times(pairs), len(ws)),
            odds(len(lines) - len(set(lines)), len(lines)), math.log(1 + len(ws) / max(len(lines), 1)), odds(sum(len(w) <= 2 for w in ws), len(ws)), odds(sum(len(w) >= 14 for w in ws), len(ws)),
            odds(sum(symbol(w[-1]) for w in ws), len(ws)), odds(sum(w[0] in ascii_uppercase for w in ws), len(ws)),
        ]

    rnd = random.Random(2)
    texts = [None, "", " \n", "One", "a a a\na a a\n\nB$ c# 12"] + ["".join(rnd.choice("abcXYZ019 .,;$#\n\té") for _ in range(rnd.randrange(300))) for _ in range(60)]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(slow(t)), t


def test_discriminant_equals_the_formula():
    rnd = np.random.default_rng(2)
    d = len(quality.NAMES)
    x = np.concatenate([rnd.normal(0, 1, (300, d)), rnd.normal(0.7, 2, (200, d))])
    y = np.repeat([0, 1], [300, 200])
    m = quality.fit(x, y, 0.2, 0.1)
    z = (x - x.mean(0)) / x.std(0)
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p.T) for p in parts]
    both = (299 * covs[0] + 199 * covs[1]) / 498
    logs = []
    for p, c in zip(parts, covs):
        c = 0.8 * c + 0.2 * both
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        r = z - p.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", r, np.linalg.inv(c), r) + np.linalg.slogdet(c)[1]))
    assert np.allclose(m.difference(x), logs[1] - logs[0])


# ---- licenses


def test_alignment_and_winnowing():
    w = lambda s: s.encode().split()
    assert licenses.align(w("a b c d"), w("x a b c d y")) == (1, 5, [(0, 1), (1, 2), (2, 3), (3, 4)])
    assert licenses.align(w("a b c d"), w("a b q c d")) == (0, 5, [(0, 0), (1, 1), (2, 3), (3, 4)])
    assert licenses.align(w("a b c d e f"), w("a b d e f"))[2] == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    assert licenses.align(w("a b"), w("c d")) == (0, 0, [])
    kept = licenses.winnow(w("a b c d e f g h"), 3, 2)
    places = [k for _, k in kept]
    assert all(any(p in places for p in (k, k + 1)) for k in range(5))


def test_license_scan(spark, docs, none):
    pad = "some other words stand here and there "
    texts = {
        1: pad + "Licensed under the Apache License, Version 2.0. " + pad,
        2: pad + "released UNDER the\nMIT license. " + pad + "Licensed under CC BY-NC 4.0.",
        3: pad + "Licensed under the Apache great License, Version 2.0." + pad,
        4: "The license was under the version of the word, released to the public.",
        5: ("This work is licensed under the GNU General Public License, version 3.\n" + pad) * 50,
        6: None,
        7: "é " + dict(licenses.TEMPLATES)["Unlicense"],
    }
    got = {r["doc_id"]: r for r in rows_of(licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    assert (got[1]["licenses"], got[1]["n_matches"], got[1]["coverage"]) == ("Apache-2.0", 1, 1.0)
    assert texts[1][got[1]["span_start"] : got[1]["span_end"]] == "Licensed under the Apache License, Version 2.0"
    assert got[2]["licenses"] == "CC-BY-NC-4.0,MIT" and got[2]["n_matches"] == 2
    assert got[3]["licenses"] == "Apache-2.0" and got[4]["n_matches"] == 0 and got[5]["n_matches"] == 50 and got[6]["n_matches"] == 0
    assert texts[7][got[7]["span_start"] : got[7]["span_end"]].startswith("This is free") and got[7]["licenses"] == "Unlicense"
    assert len(rows_of(licenses.scan_licenses(docs))) == len(corpus()) and rows_of(licenses.scan_licenses(none)) == []


def test_edited_licenses_are_found():
    """Templates with a tenth of their words changed, but for those that decide, inside other text."""
    rnd, scanner = random.Random(6), licenses.Scanner()
    for name, template in licenses.TEMPLATES:
        own = template.split()
        free = [k for k, x in enumerate(own) if not any(licenses.decides(w) or w.decode() in licenses.NAMED for w in licenses.words_of(x.encode()))]
        for _ in range(3):
            ws = list(own)
            for k in rnd.sample(free, len(ws) // 10):
                ws[k] = rnd.choice(["", "changed", ws[k] + " more"])
            text = " ".join(rnd.choice(WORDS) for _ in range(50)) + ". " + " ".join(ws) + " " + " ".join(rnd.choice(WORDS) for _ in range(50))
            found = scanner.scan(text.encode())
            assert [m.license for m in found] == [name]
    assert all(not scanner.scan((r[1] or "").encode()) for r in corpus())


def test_siblings_are_told_apart():
    """Every template is found as its own licence only, and none of a family's members is taken for another."""
    scanner = licenses.Scanner()
    of = lambda t: {m.license for m in scanner.scan(("one two " + t + " three four").encode())}
    for name, text in licenses.TEMPLATES:
        assert of(text) == {name}
    short = {"CC BY": "CC-BY", "CC BY-SA": "CC-BY-SA", "CC BY-ND": "CC-BY-ND", "CC BY-NC": "CC-BY-NC", "CC BY-NC-SA": "CC-BY-NC-SA", "CC BY-NC-ND": "CC-BY-NC-ND"}
    for text, name in short.items():
        assert of(f"Licensed under {text} 4.0.") == {f"{name}-4.0"} and of(f"Licensed under {text} 3.0.") == set()
    for family, names in {"": {"2": "GPL-2.0", "3": "GPL-3.0"}, "Lesser ": {"2.1": "LGPL-2.1", "3": "LGPL-3.0", "2": None}, "Affero ": {"3": "AGPL-3.0", "1": None}}.items():
        for version, name in names.items():
            for form in (f"This work is licensed under the GNU {family}General Public License, version {version}.", f"You may use it under the GNU {family}General Public License version {version} here"):
                assert of(form) == ({name} if name else set()), form
    assert of("Licensed under the Apache License, Version 1.1.") == {"Apache-1.1"} and of("Licensed under the Apache License, Version 1.0.") == set()
    assert of("Released under the zzz License") == set() and of("MIT. Licensed under the Apache License, Version 2.0. 12 of them") == {"Apache-2.0"}
    assert of("Released under the BSD License") == {"BSD"} and of("Released under the 2-Clause BSD License") == {"BSD-2-Clause"}


def slow_scan(words, templates):
    """All windows, aligned without a band; of a template's overlapping spans the best, and of those that fit again."""
    scanner, found, joined = licenses.Scanner(templates), [], licenses.Joined(b" ".join(words))
    apart = lambda m, k: m[1] <= k[0] or k[1] <= m[0]
    for t, (_, own) in enumerate(scanner.templates):
        spans = []
        for begin in range(len(words)):
            for size in (len(own), len(own) + 3):
                a, b, matched = licenses.align(own, words[begin : begin + size], None)
                if len(matched) >= licenses.COVERAGE * len(own):
                    spans.append((begin + a, begin + b, [(i, begin + j) for i, j in matched]))
        best = []
        for m in sorted(spans, key=lambda m: (-len(m[2]), m[1] - m[0], m[0])):
            if all(apart(m, k) for k in best):
                best.append(m)
        found += filter(None, (scanner.fits(t, words, m, joined) for m in best))
    kept = []
    for m in sorted(found, key=lambda m: (-m.matched, -m.coverage, m.first, m.license)):
        if all(apart((m.first, m.last), (k.first, k.last)) for k in kept):
            kept.append(m)
    return sorted((m.license, m.first, m.last) for m in kept)


def test_scan_against_all_windows():
    rnd = random.Random(12)
    templates = [x for x in licenses.TEMPLATES if len(licenses.words_of(x[1].encode())) <= 8]
    scanner = licenses.Scanner(templates)
    for _ in range(40):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            own = rnd.choice(templates)[1].split()
            if rnd.random() < 0.6:
                own[rnd.randrange(len(own))] = rnd.choice(["zzz", "nc", "3", "lesser"])
            parts += [*(rnd.choice(WORDS) for _ in range(rnd.randrange(3, 9))), *own]
        words_ = licenses.words_of(" ".join(parts).encode())
        assert sorted((m.license, m.first, m.last) for m in scanner.scan(b" ".join(words_))) == slow_scan(words_, templates), words_


@pytest.mark.parametrize("notice", [t for _, t in licenses.TEMPLATES if len(licenses.words_of(t.encode())) <= 8])
def test_notices_directly_after_themselves(notice):
    for n in (1, 2, 3, 7, 50):
        text = "some words " + " ".join([notice] * n) + " and more"
        found = sorted(licenses.Scanner().scan(text.encode()), key=lambda m: m.first)
        size = len(licenses.words_of(notice.encode()))
        assert [(m.first, m.last, m.coverage) for m in found] == [(2 + k * size, 2 + (k + 1) * size, 1.0) for k in range(n)]


def test_short_notices_with_one_word_changed():
    scan = lambda t: [(m.license, m.matched) for m in licenses.Scanner().scan(t.encode())]
    assert scan("Some text. Released under an MIT License.") == [("MIT", 4)]
    assert scan("Some text. All rights reserved.") == [("All-rights-reserved", 3)]
    for name, text in licenses.TEMPLATES:
        words = licenses.words_of(text.encode())
        if 4 <= len(words) <= licenses.SHORT:
            for k in range(len(words)):
                changed = b" ".join([*words[:k], b"zzz", *words[k + 1 :]]).decode()
                found = [n for n, _ in scan(f"one two {changed} three four")]
                needed = licenses.decides(words[k]) or words[k].decode() in licenses.NAMED
                assert name not in found if needed else name in found, changed
