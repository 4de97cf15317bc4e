"""Brute force, round trips, held-out accuracy and odd inputs for the corpus operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lineweave.llm import bpe_codec, bpe_count, bytescan, components, lm, mixing, neardup, quality, queries, sharding, suffix, topk, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, _key string, node string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def documents(spark, rows):
    """rows: (doc_id, text[, source]); the further columns clash with names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 1, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    random.seed(3)
    passage = " ".join(random.choice(["alpha", "beta", "Größe", "ça", "x"]) + str(random.randrange(90)) for _ in range(120))
    rows = [(1, passage), (2, passage.encode().upper().decode()), (3, passage), (3, passage), (4, passage + " tail"), (5, "lead " + passage), (6, ""), (7, None), (None, "no id"), (None, passage + " other")]
    rows += [(8, "a b"), (9, "A  B"), (10, "one two three four five"), (11, LONG), (12, "   "), (13, "a" * 1000), (14, "😀 é"), (15, " ".join(passage.split()[:110]))]
    return [(i, t, [None, "b", "a", "Z"][n % 4]) for n, (i, t) in enumerate(rows)]


def collect(df):
    return [r.asDict() for r in df.collect()]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# --- sharding


def test_shards_move_only_into_the_new_one(spark):
    got = collect(sharding.assign(documents(spark, odd_rows())))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by = {r[0]: (r[1] or "").encode() for r in odd_rows() if r[0] not in (None,)}
    for r in got:
        if r["doc_id"] is not None:
            assert r["size"] == len(by[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(by[r["doc_id"]])


def test_weights_share_the_keys(spark):
    got = sharding.with_shard(spark.range(20_000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in got}[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.choose("id", [])


# --- quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in scored])
    bad = [r["predicted"] == 0 for r in scored if r["quality"] == 0]
    good = [r["predicted"] == 1 for r in scored if r["quality"] == 1]
    assert right > 0.97 and np.mean(bad) > 0.85 and np.mean(good) > 0.98


def test_quality_dictionaries_take_whole_short_texts():
    texts = [b"a" * 10, b"b" * 5000, b"c" * 20, b"d" * 30, b"e" * 40, b"f" * 9000]
    chosen, rest = quality.divide(texts, 600, 4096)
    assert chosen == [texts[i] for i in (0, 2, 3, 4)] and rest == [texts[1], texts[5]]
    chosen, rest = quality.divide([b"x" * 5000, b"y" * 6000, b"z" * 7000], 600, 4096)
    assert len(chosen) == 2 and len(rest) == 1
    assert len(quality.divide([b"x"] * 9, 3, 4096)[0]) == 3


def test_quality_learns_from_a_sample_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} " * 20) for i in range(200)] + [(1000, "long " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 1)], "doc_id long, quality int")
    full = quality.learn(docs, labels, quality.Bounds(longest=20_000))
    assert full.good and full.bad and full == quality.learn(docs.where("doc_id < 1000"), labels, quality.Bounds(longest=20_000))
    small = quality.learn(docs, labels, quality.Bounds(sample_bytes=300))
    assert not small.good and not small.bad


def test_quality_without_labels_or_with_odd_ones(spark):
    docs = documents(spark, odd_rows())
    for labels in ([], [(None, 1), (1, None), (1, 0), (1, 1), (2, 1)]):
        model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = collect(quality.score(docs, model))
        assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(docs, model).schema == docs.schema


# --- near duplicates


def brute_groups(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def test_near_duplicates_are_those_of_brute_force(spark):
    random.seed(5)
    base = [f"w{random.randrange(400)}" for _ in range(150)]
    rows = odd_rows()
    for i in range(60):
        w = list(base)
        for _ in range(random.randrange(0, 9)):
            w[random.randrange(len(w))] = f"z{random.randrange(10**6)}"
        rows.append((100 + i, " ".join(w), "s"))
    for block in (neardup.BLOCK_SHINGLES, 900):
        got = collect(neardup.groups(documents(spark, rows), block=block))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_groups(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, odd_rows())
    got = collect(neardup.keep_one(docs))
    assert got[0].keys() == set(docs.columns) and {(r["_key"], r["shard"], r["node"]) for r in got} == {("x", 1, "y")}
    sizes = Counter(r["doc_id"] for r in got)
    assert sizes[1] == 1 and not {2, 3, 4, 5} & set(sizes) and sizes[8] == 1 and sizes[9] == 0
    assert all(sizes[i] == 1 for i in (6, 7, 12, 10, 11)) and sizes[None] == 1


def test_components(spark):
    random.seed(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 7), (500, 501)] + [(random.randrange(2000, 2100), random.randrange(2000, 2100)) for _ in range(70)]
    got = {r["node"]: r["root"] for r in components.connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[1000] == 0 and got[501] == 500
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b)


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes mod 2**64 can't tell them apart from 1024 letters on."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_stay_apart(spark):
    a, b = thue_morse(2048)
    assert len(set(bytescan.word_hashes(f"{a} {b} {a[:64]} {b[:64]} {a[:65]} {a[:8]} {a[:9]}".encode()).tolist())) == 7
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(documents(spark, [(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(100 + i, a) for i in range(5) if zlib.crc32(str(100 + i).encode()) % 7 != 2]
    known = {r["doc_id"]: r["n_known"] for r in lm.score(documents(spark, rows + [(held, b)]), parts=2).collect()}
    assert known[held] == 1 and known[rows[0][0]] == 2


# --- language model


def test_totals_beyond_32_bits():
    import pyarrow as pa

    keys = np.array([3, 7], dtype=np.uint64)
    most = np.full(2, 2**32 - 1, dtype=np.uint32)
    asked = pa.Table.from_batches([lm._rows([(c, lm.WORDS, 0, 0, lm.pack_keys(keys), lm.pack(most), None, None) for c in range(3)])])
    answers = lm.add_up(asked, lm.Settings()).to_pylist()
    assert [lm.unpack(r["a"], np.int64).tolist() for r in answers if r["kind"] == lm.TOTALS] == [[3 * (2**32 - 1)] * 2] * 3


def test_language_model_base_is_brute_force_and_score_beats_it(spark):
    rows = odd_rows() + [(i, f"the cat sat on the mat {i % 5} and the dog sat on the log", "s") for i in range(100, 400)]
    got = collect(lm.score(documents(spark, rows), settings=lm.Settings(chunk_bytes=3000, share=1e-3), parts=3))
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter(w for _, t, *_ in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    exp = Counter()
    for i, t, *_ in rows:
        w = [*words(t), None]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        exp[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(base, 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == exp
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)
    assert all(r["score"] <= 1e-9 for r in got)


def test_language_model_is_a_distribution_and_chunks_do_not_matter(spark):
    rows = [(i, "a b a b c" if i % 2 else "b c b c a a", "s") for i in range(60)]
    runs = [{r["doc_id"]: round(r["score"], 9) for r in lm.score(documents(spark, rows), settings=lm.Settings(chunk_bytes=c, share=1e-3), parts=p).collect()} for c, p in ((10, 2), (10**6, 5))]
    assert runs[0] == runs[1]
    # All one-token texts and an unknown word, each before the end token, can't sum to more than 1.
    probe = [(1000 + i, w, "s") for i, w in enumerate(["a", "b", "c", "unknown", ""])]
    held = [r for r in probe if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    got = lm.score(documents(spark, rows + held), parts=2).where("doc_id >= 1000").collect()
    assert sum(10 ** r["score"] for r in got) <= 1


def brute_tree(texts, settings):
    """Scores of the suffix tree of the texts for any text, and the contexts that are retained."""
    root, follow = Counter(), {}
    for t in texts:
        w = ["^", *words(t), None]
        for i in range(1, len(w)):
            root[w[i]] += 1
            for d in range(1, min(settings.depth, i) + 1):
                follow.setdefault(tuple(w[i - d : i]), Counter())[w[i]] += 1
    n, v = sum(root.values()), len(root)

    def kept(context):
        own = follow[context]
        size, suffix = sum(own.values()), follow[context[1:]] if len(context) > 1 else root
        gain = sum(c * math.log(c / size / (suffix[x] / sum(suffix.values()))) for x, c in own.items())
        return size >= (settings.least if len(context) == 1 else settings.least_deep) and gain >= settings.divergence + settings.per_follower * len(own)

    states = {c for c in follow if kept(c)}

    def score(text):
        w, out = ["^", *words(text), None], 0.0
        for i in range(1, len(w)):
            p = (root[w[i]] + v / (v + 1)) / (n + v)
            longest = max((d for d in range(1, min(settings.depth, i) + 1) if tuple(w[i - d : i]) in states), default=0)
            for d in range(1, longest + 1):
                own = follow[tuple(w[i - d : i])]
                p = (own[w[i]] + len(own) * p) / (sum(own.values()) + len(own))
            out += math.log10(p)
        return out

    return score, states


def scored_as_by_brute_force(spark, rows, **settings):
    settings = lm.Settings(**settings)
    score, states = brute_tree([t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2], settings)
    got = {r["doc_id"]: r["score"] for r in lm.score(documents(spark, rows), settings=settings, parts=3).collect()}
    assert len(got) == len(rows) and all(abs(got[i] - score(t)) < 1e-6 for i, t, *_ in rows)
    return states


def test_language_model_retains_rare_contexts_of_a_large_corpus(spark):
    # Of about 400,000 training tokens a share of 1e-4 would be 40 and of 1e-3, for the words of pairs, 400.
    random.seed(8)
    rows = [(i, " ".join(f"f{random.randrange(3000)}" for _ in range(1000)), "s") for i in range(470)]
    rows += [(1000 + i, "rare red apple", "s") for i in range(35)] + [(2000 + i, "odd blue pear" if i % 2 else "even blue plum", "s") for i in range(100)]
    states = scored_as_by_brute_force(spark, rows, chunk_bytes=500_000)
    assert {("red",), ("rare",), ("odd", "blue"), ("even", "blue")} <= states


def test_language_model_tells_a_pair_from_its_suffix(spark):
    # 'y' and 'x y' lie about equally far from the root, in different directions.
    rows = [(i, "q y a" if i % 10 else "x y b", "s") for i in range(350)] + [(1000 + i, "b b b", "s") for i in range(350)]
    assert {("y",), ("x", "y")} <= scored_as_by_brute_force(spark, rows)


def test_language_model_goes_as_deep_as_contexts_differ(spark):
    rows = [(i, ("p x y a", "q x y b")[i % 2] + " m n", "s") for i in range(300)] + [(1000 + i, "u x y c v a b", "s") for i in range(100)]
    for depth, deepest in ((2, 2), (3, 3), (4, 3)):
        states = scored_as_by_brute_force(spark, rows, depth=depth)
        assert max(map(len, states)) == deepest and (depth == 2 or {("p", "x", "y"), ("q", "x", "y")} <= states)


# --- repeated strings


def brute_repeats(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 2, dtype=int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                covered[i + 1 : i + 1 + size] = 1
        flags = covered[1:-1].astype(bool)
        kept = np.frombuffer(t, dtype=np.uint8)[~flags].tobytes()
        out.append((len(t), int(flags.sum()), int((np.diff(covered) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix.MOST, 2])
def test_repeats_are_those_of_brute_force(spark, most):
    random.seed(11)
    passages = [" ".join(random.choice(["alpha", "béta", "x", "yy"]) + str(random.randrange(50)) for _ in range(90)) for _ in range(4)]
    rows = [r for r in odd_rows() if r[0] != 11]
    rows += [(200 + i, f"{random.random()} " + random.choice(passages)[random.randrange(60) :] + f" {random.random()}" * random.randrange(3), "s") for i in range(60)]
    rows += [(300, "ab" * 700, "s"), (301, "x" * 399, "s"), (302, "ab" * 300 + "c", "s"), (303, "q" * 400, "s")]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove(documents(spark, rows), most=most).collect())
    exp = brute_repeats([(r[1] or "").encode() for r in rows], 400)
    assert got == Counter((r[0], *e) for r, e in zip(rows, exp, strict=True))


def sorted_shards(rng, n, alphabet, length):
    base = [bytes(rng.choices(alphabet, k=length)) for _ in range(5)]
    rows = [rng.choice(base)[: rng.randrange(length)] for _ in range(n)]
    rows = [r + bytes(rng.choices(alphabet, k=length - len(r))) for r in rows]
    block, shard, rank = np.array(rng.choices(range(4), k=n)), np.array(rng.choices(range(6), k=n)), np.zeros(n, dtype=int)
    for s in range(6):
        for place, i in enumerate(sorted(np.flatnonzero(shard == s), key=lambda i: (block[i], rows[i]))):
            rank[i] = place
    return rows, block, shard, rank


def test_merged_shards_are_one_order_with_its_common_prefixes():
    rng = random.Random(12)
    for _ in range(60):
        rows, block, shard, rank = sorted_shards(rng, rng.randrange(1, 80), rng.choice([b"ab", b"abc\0", b"abcdefgh"]), 40)
        order, common = suffix.interleave(block, shard, rank, suffix.symbols_of(rows, 40))
        merged = [(block[i], rows[i]) for i in order]
        assert merged == sorted(merged) and sorted(order.tolist()) == list(range(len(rows)))
        for before, here, c in zip(merged, merged[1:], common[1:].tolist(), strict=False):
            same = next((k for k in range(40) if before[1][k] != here[1][k]), 40)
            assert c == (same if before[0] == here[0] else -1)


def test_merging_needs_sorted_shards():
    rows = [b"bbbbbbbb" * 5, b"aaaaaaaa" * 5, b"abababab" * 5]
    given = suffix.interleave(np.zeros(3, int), np.zeros(3, int), np.arange(3), suffix.symbols_of(rows, 40))[0]
    assert given.tolist() == [0, 1, 2]  # the order of a shard is taken, not made
    order, _ = suffix.interleave(np.zeros(4, int), np.array([0, 0, 0, 1]), np.array([1, 0, 2, 0]), suffix.symbols_of([b"a" * 39 + b"c", b"a" * 39 + b"d", b"a" * 39 + b"b", b"c" * 40], 40))
    assert order.tolist() == [1, 0, 2, 3]


def brute_passages(texts, size=51):
    """How many runs under repeated windows of words each text has, and the text without them."""
    cut = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in cut for i in range(len(w) - size + 1))
    out = []
    for t, w in zip(texts, cut, strict=True):
        covered = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                covered[i : i + size] = [True] * size
        runs = sum(c and not b for b, c in zip([False, *covered], covered, strict=False))
        out.append(runs)
    return out


@pytest.mark.parametrize("most", [suffix.MOST, 2])
def test_passages_are_those_of_brute_force(spark, most):
    random.seed(14)
    passages = [[random.choice(["of", "à", "xyz", "The"]) + str(random.randrange(30)) for _ in range(60)] for _ in range(4)]
    rows = [r for r in odd_rows() if r[0] != 11]
    for i in range(80):
        p = random.choice(passages)[random.randrange(14) :]
        p = [w.upper() if i % 7 == 0 else w for w in p]
        rows.append((200 + i, f"{random.random()} start " + random.choice([" ", "  ", "\n"]).join(p) + f" {random.random()}" * random.randrange(3), "s"))
    rows += [(400, "ho " * 50, "s"), (401, "hi " * 52, "s"), (402, "one " + "ha " * 51, "s"), (403, "two " + "ha " * 51, "s")]
    got = Counter((r["doc_id"], r["n_passages"]) for r in suffix.remove(documents(spark, rows), most=most).collect())
    assert got == Counter((r[0], n) for r, n in zip(rows, brute_passages([r[1] for r in rows]), strict=True))


def test_cleaned_cuts_short_strings_of_many_words(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [(1, f"left one {passage} right one"), (2, f"left two {passage.upper()}\nend two"), (3, " ".join(f"w{i}" for i in range(50)) + " kept")]
    got = {r["doc_id"]: r["text"] for r in suffix.cleaned(documents(spark, rows)).collect()}
    assert got == {1: "left one  right one", 2: "left two \nend two", 3: rows[2][1]}


def test_repeats_in_pieces_of_a_long_text():
    random.seed(2)
    unit = bytes(random.choices(b"abcdefgh ", k=300_000))
    text = unit + b"-" + unit[1000:200_000]
    g, h, w, at, s = suffix.anchors(text)
    assert w.sum() == len(text) - 399 and (s[1:] == s[:-1] + w[:-1]).all()


def test_cleaned_keeps_columns_and_whole_characters(spark):
    docs = documents(spark, odd_rows())
    got = collect(suffix.cleaned(docs))
    assert len(got) == len(odd_rows()) and got[0].keys() == set(docs.columns) and {(r["_key"], r["node"]) for r in got} == {("x", "y")}
    assert {r["text"] for r in got if r["doc_id"] in (1, 3)} == {""} and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


# --- vectors


def brute_vectors(rows, cosine=0.98):
    ok = [r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    link = [[] for _ in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=float), np.array(b[1], dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    link[i].append(j)
    out = Counter()
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[(r[0], len(link[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))] += 1
    return out


def test_vectors_link_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * s).tolist(), i % 2) for i, s in enumerate(rng.uniform(0.02, 0.25, 300))]
    rows += [(500 + i, rng.standard_normal(64).tolist(), i % 3) for i in range(100)]
    rows += [(600, None, 1), (601, [0.0] * 64, 1), (602, [float("nan")] * 64, 1), (603, [None] * 64, 1), (604, centre.tolist(), None), (605, [1e20] * 3, 1), (606, [2e20] * 3, 1), (607, [], 1), (None, centre.tolist(), 1), (10, rows[10][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    for block in (vectors.BLOCK_VECTORS, 25):
        got = vectors.groups(df, block=block).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    a, b = vectors.unit(rng.standard_normal((300, 64))), vectors.unit(rng.standard_normal((300, 64)))
    turn = vectors.rotations(64, 64, seed=11)
    signs = np.where(b @ turn >= 0, 1.0, -1.0) / 8
    estimate = (a @ turn) @ signs.T / np.einsum("ij,ij->i", signs, b @ turn)
    assert abs((estimate - a @ b.T).mean()) < 2e-3
    assert (vectors.linked(a, a, 0.98) == (a @ a.T >= 0.98)).all()


def test_codes_spare_most_vectors():
    rng = np.random.default_rng(18)
    a = vectors.unit(rng.standard_normal((400, 64)))
    near = vectors.unit(a[:40] + 0.01 * rng.standard_normal((40, 64)))
    b = np.concatenate([near, vectors.unit(rng.standard_normal((360, 64)))])
    open_pairs = vectors.Codes.of(a).undecided(vectors.Codes.of(b), 0.98)
    assert (open_pairs >= (a @ b.T >= 0.98)).all() and 40 <= open_pairs.sum() <= 60
    c = vectors.Codes.of(a)
    assert c.bits.nbytes + c.factor.nbytes + c.small.nbytes + c.scale.nbytes <= a.nbytes / 4


# --- mixing


def test_mix_meets_targets(spark):
    rows = odd_rows() + [(1000 + i, "w " * (i % 37), ["a", "b", "Z", None, "ü"][i % 5]) for i in range(500)]
    got = collect(mixing.plan(documents(spark, rows)))
    assert all(r["taken"] <= 2 * r["size"] for r in got) and len(got) == len(rows)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in by.items()) and abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    again = collect(mixing.plan(documents(spark, rows[::-1])))
    key = lambda r: sorted((str(x["doc_id"]), x["size"], x["taken"]) for x in r)
    assert key(got) == key(again)


def test_mix_includes_by_size(spark):
    rows = [(i, "w " * (1 + i % 4 * 10), "s") for i in range(4000)]
    got = mixing.plan(documents(spark, rows), share=0.5).where("taken = size").groupBy("size").count().collect()
    share = {r["size"]: r["count"] / 1000 for r in got}
    size = np.array([1, 11, 21, 31])
    low, high = 0.0, 10.0
    for _ in range(60):  # the multiple at which odds of k times the size give half of all words
        k = (low + high) / 2
        low, high = (k, high) if (size * k * size / (1 + k * size)).sum() < size.sum() / 2 else (low, k)
    assert all(abs(share[n] - k * n / (1 + k * n)) < 0.05 for n in size.tolist())


def test_mix_keeps_columns_called_as_its_own(spark):
    docs = documents(spark, odd_rows()).selectExpr("*", "1 as _size", "2 as _u", "3 as _home", "'4' as whole")
    got = collect(mixing.plan(docs, keep=["_size", "_u", "_home", "whole"]))
    assert len(got) == len(odd_rows()) and {(r["_size"], r["_u"], r["_home"], r["whole"]) for r in got} == {(1, 2, 3, "4")}


def test_mix_gives_the_words_it_plans(spark):
    rows = [(i, " ".join(f"{i}.{j}" for j in range(i % 9)), "ab"[i % 2]) for i in range(80)]
    docs = documents(spark, rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan(docs).collect()}
    mixed = Counter()
    assert mixing.apply(docs).columns == docs.columns
    for r in mixing.apply(docs).where("_key = 'x' and shard = 1").collect():
        mixed[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in plan.items() if v} == dict(mixed)


# --- tokens


def token_texts():
    random.seed(6)
    odd = [LONG[:20_000], "a" * 3000, "<|endoftext|>x<|endoftext|>", " \x1c\x85 　 a", "ab­😀😀é １２ Ⅷ", "\n\n  x\t", "it's 're'll 'S", ""]
    return odd + ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0x3000), random.randrange(0x10000, 0x1F000), 9, 10, 32])) for _ in range(200)) for _ in range(40)]


def test_counts_are_the_librarys(spark):
    texts = token_texts()
    own = bpe_count.Counter.from_json(P.path("byte_bpe_50k.json"), P.PATTERN, memo=50)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in collect(bpe_count.count_tokens(documents(spark, odd_rows()), P.path("byte_bpe_50k.json"), P.PATTERN))}
    assert got[7]["n_tokens"] == got[7]["n_bytes"] == 0 and got[11]["over_limit"]


def test_transducer_is_the_library_and_decodes(spark):
    texts = token_texts()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    own = bpe_codec.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, memo=20)
    own.transducer.most_states = 200
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    docs = documents(spark, odd_rows())
    tokens = bpe_codec.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = Counter((r["doc_id"], r["text"]) for r in bpe_codec.decode(tokens, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert back == Counter((r[0], r[1] or "") for r in odd_rows())


def test_stream_decoder_hands_out_whole_characters():
    decoder = bpe_codec.StreamDecoder({i: bytes([i]) for i in range(256)})
    out = [decoder.feed([b]) for b in "aé😀".encode()]
    assert out == [b"a", b"", "é".encode(), b"", b"", b"", "😀".encode()] and decoder.end() == b""
    assert decoder.feed([0xE2, 0x82]) == b"" and decoder.end() == b"\xe2\x82"


# --- top-k


def test_top_k_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 50][1]) for i in range(150)] + [(900, None), (901, [None] * 16), (902, [float("inf")] * 16), (950, rows[0][1][:4]), (951, [1.0] * 4), (1000, [1e12] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, part int")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    exp = set()
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), c) for c, w in good if c != q and len(w) == len(v))[:5]
            exp |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    for settings in ({}, {"part": 64, "block": 8, "chunk": 3}):
        assert {tuple(r) for r in topk.top_k(df, **settings).collect()} == exp


def test_blocks_are_pruned():
    ids = np.arange(1000)
    rows = np.zeros((1000, 4))
    rows[:, 0] = ids
    index = topk.Blocks(ids, rows, 10)
    got = index.search(-1, np.array([1.0, 0, 0, 0]), 5)
    assert got[0].tolist() == [999, 998, 997, 996, 995] and index.scored < 100


# --- all of them


def test_empty_tables(spark):
    docs = documents(spark, [])
    path = P.path("byte_bpe_50k.tiktoken")
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    runs = [sharding.assign(docs), quality.score(docs, quality.learn(docs, labels)), neardup.groups(docs), neardup.keep_one(docs), lm.score(docs), suffix.remove(docs), suffix.cleaned(docs)]
    runs += [vectors.groups(empty), mixing.plan(docs), mixing.apply(docs), bpe_count.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN), bpe_codec.digests(docs, path, P.PATTERN), topk.top_k(empty)]
    assert [r.count() for r in runs] == [0] * len(runs)


def test_hashes_of_long_texts_do_not_depend_on_pieces():
    text = (LONG + "  " + "x" * 5000 + " end").encode()
    assert (bytescan.word_hashes(text, piece=1000) == bytescan.word_hashes(text)).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).toPandas(), docs.schema)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] == sizes[2] and sizes[0] < docs.count()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    exp = Counter()
    for r in now.collect():
        ids = library.encode_ordinary(r["text"] or "")
        exp[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == exp


def run_stages(spark, docs):
    """What each stage of the pipeline gives for a table of documents, with labels for some ids."""
    import corpus_pipeline

    now, out = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        rows = now.collect()
        out.append(rows)
        now = spark.createDataFrame(rows, now.schema)
    return out


def test_pipeline_on_odd_rows(spark):
    docs = documents(spark, odd_rows())
    good, single, cut, mixed, tokens = run_stages(spark, docs)
    assert {r["_key"] for r in mixed} == {"x"} and {r["node"] for r in cut} == {"y"} and set(mixed[0].asDict()) == set(docs.columns)
    assert {7, 6} <= {r["doc_id"] for r in good} and len(single) < len(good) and len(cut) == len(single) and len(tokens) == len(mixed)
    assert [len(x) for x in run_stages(spark, docs.limit(0))] == [0] * 5


def test_third_stage_is_brute_force(spark):
    random.seed(15)
    passages = [" ".join(random.choice(["of", "à", "xyz", "antidisestablishment"]) + str(random.randrange(30)) for _ in range(n)) for n in (55, 70, 40)]
    rows = [(i, f"{random.random()} " + random.choice(passages)[random.randrange(20) :] + f" {random.random()}", "s") for i in range(60)] + [(100, None), (101, ""), (102, "ab" * 700)]
    got = {r["doc_id"]: r["text"] for r in suffix.cleaned(documents(spark, rows)).collect()}
    raws = [(r[1] or "").encode() for r in rows]
    strings = Counter(t[i : i + 400] for t in raws for i in range(len(t) - 399))
    tokens = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in raws]
    runs = Counter(tuple(w[2] for w in ws[i : i + 51]) for ws in tokens for i in range(len(ws) - 50))
    for r, t, ws in zip(rows, raws, tokens, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if strings[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        for i in range(len(ws) - 50):
            if runs[tuple(w[2] for w in ws[i : i + 51])] > 1:
                gone[ws[i][0] : ws[i + 50][1]] = True
        exp = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert got[r[0]] == (None if r[1] is None else exp)


def test_odd_texts_of_the_other_operators(spark):
    docs = documents(spark, odd_rows())
    got = {r["doc_id"]: r for r in bpe_codec.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[7]["n_tokens"] == 0 and got[7]["ids_sha256"] == got[6]["decoded_sha256"] == nothing and got[11]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    model = quality.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_good(docs.limit(0), model).collect() == [] and quality.keep_good(docs, model).count() == len(odd_rows())
