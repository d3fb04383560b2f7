"""Operators against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridex.llm import bpe, exact_dedup, importance, language_id, ngram_join, packing, pii, substring_dedup, topk_search, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"
WORDS = [a + b for a in ("ba", "co", "di", "fu", "ge", "hy") for b in ("lan", "mer", "nos", "pit", "que")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "two words", "A  b\tc", "a b C", "x" * 5000, "日本語 text 🙂", "<|endoftext|> a", "<|endoftext|>"]
    base = prose(rng, 120)
    texts += [base, base, base.upper(), base.replace(" ", "  ", 3), base + " tail", " ".join(base.split()[2:]), prose(rng, 300) + " " + base + " " + prose(rng, 40)]
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(20)] + [prose(rng, 6000)]
    return [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", None, None, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect()}
    strip = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, *_ in rows()}
    for i, t, *_ in rows():
        same = [j for j in strip if strip[j] == strip[i]]
        keep = min(same, key=lambda j: (-len(rows()[j][1] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(same), keep == i, hashlib.sha256(strip[i].encode()).hexdigest())


def test_fingerprints_compose():
    rng = random.Random(1)
    for n in (0, 1, 100, 70_000):
        data = rng.randbytes(n)
        k = rng.randint(0, n)
        whole, a, b = exact_dedup.fingerprints([data, data[:k], data[k:]])
        assert exact_dedup.combine(a, b, n - k) == whole


def test_huge_texts_in_pieces(docs):
    small = {r["doc_id"]: r.asDict() for r in exact_dedup.document_fingerprints(docs).collect()}
    cut = {r["doc_id"]: r.asDict() for r in exact_dedup.document_fingerprints(docs, huge=50).collect()}
    assert small == cut


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    assert ngram_join.near_duplicate_components(empty).count() == 0
    sets = {i: shingles(t) for i, t, *_ in rows()}
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = min(label[i], label[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}


def test_linked_sets_share_a_prefix_under_every_order():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    orders = ngram_join.Orders(tokens, rng.integers(1, 9, 500).astype(np.int8))
    linked = 0
    for _ in range(400):
        x = np.unique(np.concatenate([rng.choice(tokens, rng.integers(0, 50)), rng.integers(0, 1 << 62, rng.integers(1, 200)).astype(np.uint64)]))
        y = np.unique(np.concatenate([rng.permutation(x)[: int(np.ceil(len(x) * rng.uniform(0.7, 1)))], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]))
        if ngram_join.linked(x, y):
            linked += 1
            for prefix in (lambda s: orders.first(s)[0], orders.second, orders.third):
                assert np.isin(prefix(x), prefix(y)).any()
    assert linked > 100


def thue_morse(n):
    """Two words that a polynomial hash modulo a power of two can't tell apart."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_that_polynomials_confuse(n):
    a, b = thue_morse(n)
    hashes, _ = ngram_join.word_hashes([a.encode(), b.encode()])
    assert hashes[0] != hashes[1]
    t, e = Tokenizer.from_file(BPE), bpe.encoder(BPE)
    for text in (f"{a} {b}", f"{b} {a}"):
        assert e.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_hashes_in_stretches():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab c\t\nxyz") for _ in range(rng.randint(0, 900))) for _ in range(20)] + [b"z" * 5000 + b" q", b"", b" "]
    whole, parts = ngram_join.word_hashes(texts), ngram_join.word_hashes(texts, stretch=97)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    words = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    assert [i for i, _ in words] == whole[1].tolist()
    assert len({h for h in whole[0].tolist()}) == len({w for _, w in words})


def test_shingles_of_a_few_documents_have_levels(spark):
    """Ones that no summary holds are counted in the sample, so that they come after lone ones in a prefix."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 10**9, 60)), passage]) for _ in range(20)]
    survey = spark.createDataFrame([], ngram_join.SURVEY)
    tokens, levels = ngram_join.frequent_levels(survey, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    common = ngram_join.shingle_sets([passage])[0]
    assert tokens.tolist() == common[common < ngram_join.LOW].tolist() and len(tokens) and set(levels.tolist()) == {7}  # log2(4 * 20 + 1)
    prefix, frequent = ngram_join.Orders(tokens, levels).first(ngram_join.shingle_sets(texts)[0])
    assert len(prefix) and not frequent.any()


def test_tokens_with_the_same_sharers_are_one(spark):
    """Sharers 1 and 2 have three tokens in common, the first in order stays; one of a single document goes."""
    rows = [(7, 1, 9, 2), (7, 2, 8, 1), (5, 1, 9, 4), (5, 2, 8, 3), (6, 1, 9, 6), (6, 2, 8, 5), (3, 1, 9, 0), (3, 2, 8, 0), (3, 4, 8, 0), (2, 4, 8, 1)]
    got = ngram_join.one_token_each(spark.createDataFrame(rows, "token long, id long, n int, pos int"))
    assert sorted(map(tuple, got.select("token", "id", "n", "pos", "weight").collect())) == [(3, 1, 9, 0, 1), (3, 2, 8, 0, 1), (3, 4, 8, 0, 1), (7, 1, 9, 2, 3), (7, 2, 8, 1, 3)]


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = prose(rng, 120).split()

    def edited():
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
        return " ".join(words)

    texts = [edited() for _ in range(300)] + [prose(rng, 100) for _ in range(30)]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicate_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(4)
    items = np.concatenate([np.repeat(np.arange(20), 500), rng.integers(1000, 10**9, 20_000)]).astype(np.uint64)
    rng.shuffle(items)
    token, count = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in np.array_split(items, 40):
        token, count = ngram_join._kept_counts(token, count, *np.unique(part, return_counts=True), 100)
    assert len(token) <= 100 and set(range(20)) <= set(token.tolist())


def test_bpe(docs, empty):
    assert bpe.bpe_digests(empty, BPE).count() == 0
    t = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in bpe.bpe_digests(docs, BPE).collect()}
    for i, text, *_ in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_strings():
    rng = random.Random(2)
    e, t = bpe.encoder(BPE), Tokenizer.from_file(BPE)
    texts = ["".join(rng.choice(" \n'stredlvm aé1.!\t 日0xTheing") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 700, " ".join(["long"] * 400)]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_sets_go_to_workers_in_small_batches(spark):
    df = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("abcd "), 800).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r["n"] for r in ngram_join.cut(df.mapInArrow(sizes, "n long")).collect()]
    assert sum(found) > 12e6 and max(found) < 3e6


def test_packing(docs, empty):
    assert packing.pack_documents(empty, BPE).count() == 0
    got = packing.pack_documents(docs, BPE).collect()
    t = Tokenizer.from_file(BPE)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            assert len(ids) <= 2048 or k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_breeding_beats_best_fit_on_hard_sizes():
    for sizes, capacity in (([51] * 6 + [27] * 6 + [26] * 6 + [23] * 12, 100), (([51] * 6 + [27] * 6 + [26] * 6 + [23] * 12) * 4, 100)):
        island = packing.Island(sizes, capacity, 1)
        best_fit = island.insert(np.arange(len(sizes)), [], 0.0)
        found = island.evolve([], 5, 6)
        assert len(found) < len(best_fit)
        assert sorted(i for b in found for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= capacity for b in found)


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(2)
    v[::7] = v[0]
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(400, None, 0), (401, [float("nan")] * 8, 0), (500, [None] * 8, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int")
    from pyspark.sql import functions as F

    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(df, F.col("id") % 100 == 0).collect()}
    q = np.floor(1024 * v).astype(int)
    for i in (0, 100, 200, 300):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:10]
        assert [got[i, k + 1] for k in range(10)] == [(j, -s) for s, j in best]
    assert len(got) == 40


def test_topk_of_repeated_rows_and_large_numbers(spark):
    from pyspark.sql import functions as F

    is_query = F.col("id") % 100 == 0
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df, is_query).collect())
    assert got == [(k, 1, 3 << 20) for k in (1, 2, 3)] + [(4, 2, 2 << 20)]
    assert topk_search.top_k(df.limit(0), is_query).count() == 0
    for size in (1e4, 1e5, 1e8):
        v = np.random.default_rng(7).uniform(-size, size, (30, 64))
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        got = {r["rank"]: (r["vec_id"], r["score"]) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query).collect()}
        q = [[int(c) for c in np.floor(1024 * x)] for x in v]
        clip = lambda s: max(-(1 << 63) + 2, min((1 << 63) - 1, s))
        best = sorted((-clip(sum(a * b for a, b in zip(q[0], q[j], strict=True))), j) for j in range(1, 30))[:10]
        assert [got[k + 1] for k in range(10)] == [(j, -s) for s, j in best]


def test_pii_spans_that_hold_base_spans():
    text = "Write to j\u043ehn.smith@example.com, or call."  # the second letter is Cyrillic
    base = pii.base_spans(text)
    assert [text[s:e] for s, e, _ in base] == ["hn.smith@example.com"]
    assert [text[s:e] for s, e, _ in pii.added_spans(text, base)] == ["j\u043ehn.smith@example.com"]


def test_masks_cover_all_that_spans_hold(spark):
    text = "Write to j\u043ehn.smith@example.com, or call."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.mask_pii(df).first().text == "Write to [EMAIL], or call."


def test_repeated_queries_keep_all_ranks(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0])] + [(i, [i / 16, 1.0]) for i in range(1, 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("id") % 100 == 0).where("query_id = 100").orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(n + 1, 14 - n, 1024 * 64 * (14 - n)) for n in range(10)]


def test_stages_take_clashing_names(spark):
    names = "doc_id long, text string, doc_id_ long, row_hash_ string, row_hash string, kept boolean, n long, print string, best string, x string, component_id long"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, 7, "a", "b", True, 1, "c", "d", "e", 3) for i, t in ((1, text), (2, text), (3, text + " more"), (None, "z"), (None, "z"), (4, None))]
    df = spark.createDataFrame(rows, names)
    assert sorted(str(r.doc_id) for r in exact_dedup.without_copies(df).collect()) == ["1", "3", "4", "None"]
    near = ngram_join.without_near_copies(df)
    assert near.columns == df.columns
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "4", "None"]


def test_pii(docs, empty):
    assert pii.find_pii(empty).count() == 0
    assert pii.find_pii(docs).where("spans <> ''").count() == 0
    text = "mail a.b@c.example or x [at] y [dot] org, 10.0.0.1, 4111 1111 1111 1111, +1 (389) 555-5010, two zero one five five five zero one nine nine no"
    base = pii.base_spans(text)
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in base] == [("email", "a.b@c.example"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (389) 555-5010")]
    assert [text[s:e] for s, e, k in pii.added_spans(text, base) if k == 0] == ["x [at] y [dot] org"]
    for disguised in ("jоhn@exаmple.com", "john at example dot com", "john (at) example (dot) com", "ｊohn＠example.com"):
        t = f"see {disguised} now"
        found = pii.base_spans(t)
        assert disguised in {t[s:e] for s, e, k in found + pii.added_spans(t, found) if k == 0}
    spoken = "call plus four four two zero seven nine four six zero nine five eight today"
    assert [spoken[s:e] for s, e, k in pii.added_spans(spoken, []) if k == 3] == [spoken[5:-6]]


def test_language(spark, docs, empty):
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    got = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows())
    for r in got:
        t = rows()[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= r["score"] <= 1
    rng = random.Random(4)
    known = [(i, " ".join(rng.choice(("the house", "and then") if i % 2 else ("das Haus", "und dann")) for _ in range(5)), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(known, "doc_id long, text string, lang string")
    right = [r["lang_pred"] == known[r["doc_id"]][2] for r in language_id.predict(df, language_id.train(df)).collect() if r["held_out"]]
    assert right and sum(right) / len(right) > 0.95


def test_toxicity(spark, empty, labels):
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    rng = random.Random(6)
    data = [(i, prose(rng, 60) + (" zounds blighter" if i % 4 == 0 else "") + " " + prose(rng, 60), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, lab).collect()}
    held = [i for i, *_ in data if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == data[i][2] for i in held) / len(held) > 0.95
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0


def test_toxicity_by_plain_windows():
    """The score from windows compressed one by one, without the operator's store of windows."""
    import zstandard as z

    rng = random.Random(11)
    data = [(prose(rng, 40) + (" zounds blighter scoundrel" if i % 3 == 0 else "") + " " + prose(rng, 40), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit([(*toxicity.bag(t), y) for t, y in data])
    assert b"zounds" in model.marks and b"lan" not in model.marks
    params = z.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=17, search_log=7, min_match=5, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content, x: len(z.ZstdCompressor(compression_params=params, dict_data=z.ZstdCompressionDict(toxicity.wide(content), dict_type=z.DICT_TYPE_RAWCONTENT)).compress(toxicity.wide(x) if x else b""))
    for text in (data[0][0], data[1][0], "", "zounds", "A zounds, and Blighter!"):
        words = [w.strip(toxicity.EDGES) for w in text.lower().encode().split()]
        hits = []
        for w in {w for w in words if len(w) > 3}:
            left = size(model.usual + model.marks, b" " + w + b" ")
            gain = size(model.usual, b" " + w + b" ") - left
            if gain >= toxicity.LEAST_GAIN and left - size(model.usual + model.marks, b"") <= model.most_left:
                hits.append(gain)
        x = [len(hits) / (len(words) + 6) ** 0.5, sum(hits) / (len(words) + 6) ** 0.5 / 16, min(len(hits), 3)]
        assert toxicity.scorer(model)(text) == pytest.approx(sum(a * b for a, b in zip(model.weights, x, strict=True)) + model.bias)


def test_importance_by_brute_force(spark):
    import math

    rng = random.Random(3)
    data = [(i, prose(rng, rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, "")]
    good = {i for i in range(0, 60, 3)}
    df = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i in good)) for i in range(62)], "doc_id long, quality int")
    grams = lambda t: (w := (t or "").lower().split()) + list(zip(w, w[1:], strict=False))
    cell = {}

    def bucket(g):
        if g not in cell:
            cell[g] = int(importance._cells([" ".join(g) if isinstance(g, tuple) else g])[0][-1])
        return cell[g]

    raw, target = [1.0] * importance.BUCKETS, [1.0] * importance.BUCKETS
    for i, t in data:
        for g in grams(t):
            raw[bucket(g)] += 1
            target[bucket(g)] += i in good
    got = {r["doc_id"]: r for r in importance.resample(df, lab, keep=0.4).collect()}
    for i, t in data:
        want = sum(math.log(target[bucket(g)] / sum(target)) - math.log(raw[bucket(g)] / sum(raw)) for g in grams(t))
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-4)
    order = sorted(got.values(), key=lambda r: -r["noisy_weight"])
    assert {r["doc_id"] for r in got.values() if r["kept"]} == {r["doc_id"] for r in order[:25]}


def test_kth_largest_and_ties(spark):
    values = [5.0, 5.0, 1.0, 2.0, 9.0, 9.0, 9.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 9):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_importance(docs, empty, labels):
    assert importance.resample(empty, labels).count() == 0
    got = importance.resample(docs, labels, keep=0.5).collect()
    kept = [r for r in got if r["kept"]]
    assert len(kept) == -(-len(rows()) // 2)
    assert min(r["noisy_weight"] for r in kept) >= max((r["noisy_weight"] for r in got if not r["kept"]), default=-1e9)


def test_passages(spark, empty):
    assert substring_dedup.repeated_passages(empty).count() == 0
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, fuzzy = some(80), None
    fuzzy = [w if k % 25 else "zz" for k, w in enumerate(passage)]
    texts = [some(100) + passage + some(50), some(10) + passage, some(200), some(30) + fuzzy + some(30), some(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, None), (None, " ".join(passage))], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    where = {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} | {(r["other_id"], r["other_start"], r["other_end"]) for r in got}
    assert {d for d, _, _ in where} == {0, 1, 3}
    assert (0, 100, 180) in where and (1, 10, 90) in where


def test_passages_whose_seeds_are_scattered(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = some(60)
    crowd = lambda: [some(12) + passage[k : k + 8] + some(12) for k in range(53) for _ in range(3)]
    texts = [*crowd(), some(20) + passage + some(20), *crowd(), some(30) + passage + some(10)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r["doc_id"], r["start_word"], r["end_word"], r["other_id"], r["other_start"], r["other_end"]) for r in substring_dedup.repeated_passages(df).collect()]
    assert (319, 30, 90, 159, 20, 80) in got


@pytest.mark.parametrize("most", [16, 1 << 20])
def test_changed_passages_whose_phrases_stand_in_other_documents(spark, monkeypatch, most):
    # no anchor is left and each seed is in eight documents, most of them with eight words of the passage only
    monkeypatch.setattr(substring_dedup, "BATCH_PARTNERS", most)
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, want = [], set()
    for _ in range(10):
        passage = some(60)
        crowd = lambda: [some(12) + passage[k : k + 8] + some(12) for k in range(53) for _ in range(3)]  # noqa: B023, E731
        texts += crowd() + [some(20) + passage + some(20)]
        at = len(texts) - 1
        texts += crowd() + [some(30) + [w if k % 12 != 6 else f"new{k}" for k, w in enumerate(passage)] + some(10)]
        want.add((len(texts) - 1, at))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == want
    assert all(r["start_word"] <= 36 and r["end_word"] >= 84 and r["start_word"] - r["other_start"] == 10 for r in got)


def test_changed_passages_whose_common_seeds_are_far_apart(spark):
    # of each 21 words eight in a row are equal, and each seed of theirs is in eight documents
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, want = [], set()
    for _ in range(5):
        passage = some(71)
        crowd = lambda: [some(12) + passage[k : k + 8] + some(12) for k in range(64) for _ in range(3)]  # noqa: B023, E731
        texts += crowd() + [some(20) + passage + some(20)]
        at = len(texts) - 1
        texts += crowd() + [some(30) + [w if k % 21 not in (8, 14, 20) else f"new{k}" for k, w in enumerate(passage)] + some(10)]
        want.add((len(texts) - 1, at))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == want
    assert all(r["start_word"] <= 30 and r["end_word"] >= 101 and r["start_word"] - r["other_start"] == 10 for r in got)


def test_changed_passages_of_phrases_that_recur_in_both_documents(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(50_000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    phrases = [some(7) for _ in range(10)]
    apart = lambda n: [w for _ in range(n) for p in rng.sample(phrases, 10) for w in some(12) + p]
    passage = lambda: [w for p in phrases for w in p + some(1)]
    texts = [apart(4) + some(12) + passage() + some(12) + apart(8), apart(9) + some(12) + passage() + some(12) + apart(3)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r["doc_id"], r["start_word"], r["other_id"], r["other_start"], r["matches"]) for r in substring_dedup.repeated_passages(df).collect()]
    assert got == [(1, 9 * 190 + 12, 0, 4 * 190 + 12, 70)]


def test_near_seeds_of_many_documents_all_meet():
    # ten documents hold two seeds, each with words of its own between, and forty are copies of the first
    one = np.uint64(1)
    of = np.arange(10, dtype=np.int64)
    doc, place = np.repeat(of, 3), np.tile(np.array([5, 9, 16], "<u4"), 10)
    name = np.tile(np.array([3, 0, 7], np.uint64), 10)
    name[1::3] = (of.astype(np.uint64) + np.uint64(50)) * np.uint64(2) | one
    copies = np.repeat(np.arange(100, 140), 3)
    doc, place, name = np.append(doc, copies), np.append(place, np.tile(place[:3], 40)), np.append(name, np.tile(name[:3], 40))
    d, o, x, y = substring_dedup.near_matches(*substring_dedup.near_seeds(doc, place, name))
    pairs = set(zip(d.tolist(), o.tolist(), strict=True))
    assert {(a, b) for a in range(10) for b in range(a)} == {p for p in pairs if p[0] < 100}
    assert {p[0] for p in pairs} - set(range(10)) == set(range(100, 140)) and len(pairs) <= 45 + 2 * 40
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(5, 5), (16, 16)}


def test_places_of_a_repeated_seed_all_meet():
    key, doc = np.full(120, 7, np.uint32), np.repeat([1, 2], [20, 100])
    for n in (1, 3, 20):
        keep = np.concatenate([np.arange(n), 20 + np.arange(5 * n)])
        d, o, x, y = substring_dedup.matches(key[keep], doc[keep], np.concatenate([np.arange(20), np.arange(100)]).astype(np.uint32)[keep])
        assert set(d) == {2} and set(o) == {1} and set(x) == set(range(5 * n)) and set(y) == set(range(n))


def test_words_are_compared_where_hashes_met_by_chance():
    words = lambda *w: np.array(w, "<u4").tobytes()
    true, other = words(*range(20)), words(*range(100, 120))
    rows = {"doc": [5, 5, 6], "other": [1, 2, 3], "a": [[0, 14], [0, 9, 14], [0, 14]], "b": [[0, 14], [0, 9, 14], [1, 13]], "begin": [0] * 3, "words": [true, true, true], "other_begin": [0] * 3}
    rows["other_words"] = [true, other, words(50, *range(6), *range(6, 11), 99, *range(14, 20), 60)]
    kinds = {"a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "begin": pa.int32(), "other_begin": pa.int32()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k)) for k, v in rows.items()], list(rows))
    out = [(int(d), int(o), int(s), int(e), int(m)) for part in substring_dedup._align(batch) for d, o, s, e, m in zip(*(part[c] for c in ("doc_id", "other_id", "start_word", "end_word", "matches")), strict=True)]
    # equal throughout; no word equal, though seeds say so; three words less in one, of which an alignment pairs five
    assert out == [(5, 1, 0, 20, 20), (6, 3, 0, 20, 17)]


def test_chains_keep_what_their_alignment_needs():
    x = np.r_[0:30, 40:60]
    found = list(substring_dedup.pair_chains(np.full(50, 7), np.full(50, 3), x.astype("<u4"), (x + 5).astype("<u4")))
    assert len(found) == 1 and found[0][2][0] == 0 and found[0][2][-1] == 59
    a, b = (np.array(found[0][k]) for k in (2, 3))
    # only the ends of the two runs are stored
    assert a[substring_dedup.ends_of_runs(a, b, np.array([0]))].tolist() == [0, 29, 40, 59]


def test_words_that_an_alignment_pairs():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, 4000).astype("<u4"), rng.integers(0, 4, 4000).astype("<u4")
    n, m = rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    a, b = rng.integers(0, 3900, 300), rng.integers(0, 3900, 300)

    def plain(p, q):
        if len(p) == len(q) and 2 * (p == q).sum() >= len(p):
            return (p == q).sum()
        row = [0] * (len(q) + 1)
        for w in p:
            row = [0, *row[1:]] if not len(q) else [0] + [max(row[k + 1], row[k] + (q[k] == w)) for k in range(len(q))]
            for k in range(len(q)):
                row[k + 1] = max(row[k + 1], row[k])
        return row[-1]

    assert substring_dedup.common_words(x, a, n, y, b, m).tolist() == [plain(x[i : i + k], y[j : j + h]) for i, k, j, h in zip(a, n, b, m, strict=True)]


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    bucket, x, y = rng.integers(0, 5, 300), rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(0, 1 << 32, 300).astype("<u4")
    out = substring_dedup.packed(bucket, {"x": x, "y": y})
    import pyarrow as pa

    t = pa.table({"x": out["x"], "y": out["y"]})
    order = np.argsort(bucket, kind="stable")
    assert (substring_dedup.unpacked(t, "x", "<i8") == x[order]).all() and (substring_dedup.unpacked(t, "y", "<u4") == y[order]).all()


@pytest.mark.parametrize("every", [8, 10, 12])
def test_passages_with_evenly_spread_edits(spark, every):
    rng = random.Random(every)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(40):
        passage = some(60)
        texts += [some(20) + passage + some(20), some(30) + [w if k % every != every // 2 else f"new{k}" for k, w in enumerate(passage)] + some(10)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    # brute force: each pair has its passage at these places, with so many equal words
    equal = sum(k % every != every // 2 for k in range(60))
    assert 60 * substring_dedup.MIN_IDENTITY <= equal
    assert {(r["doc_id"], r["other_id"]) for r in got} == {(i + 1, i) for i in range(0, 80, 2)}
    assert all(r["start_word"] <= 36 and r["end_word"] >= 84 and r["start_word"] - r["other_start"] == 10 for r in got)


@pytest.mark.parametrize("kind, disguised", [
    ("email", "john at example [dot] com"), ("email", "john dot doe at example.com"), ("email", "john (dot) doe at example.co dot uk"), ("email", "john [at] example dot com"),
    ("email", "jean [chez] exemple.fr"), ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "one nine two.one six eight dot 1 dot one"),
])
def test_pii_of_mixed_disguises(kind, disguised):
    text = f"see {disguised} , now"
    assert [(pii.KINDS[k], text[s:e]) for s, e, k in pii.added_spans(text, pii.base_spans(text))] == [(kind, disguised)]


def plain_spans(text):
    """The contract's patterns by a plain reading."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_by_the_patterns():
    rng = random.Random(13)
    parts = ["a@b.c", "@", ".", "x", "1", "25", "255", "256", "4111 1111 1111 1111", "+49 (30) 1234567", "+", "-", " ", "%", "b.co", "10.0.0.1", "é", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_every_changed_text_has_the_hint():
    rng = random.Random(5)
    parts = [*pii.SPELLED, "oh", "plus", "dot", "at", "chez", "[at]", "(dot)", "{ chez }", "john", "com", "22", ".", "@", "<at>", "[ . ]", "_", "+"]
    changed = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "-", ", ", "  ", "."]) for _ in range(rng.randint(2, 10)))
        now = pii.Rewritten(text)
        for step in pii.TRANSDUCERS:
            now = step(now)
        changed += now.text != text
        assert now.text == text or pii.HINT.search(text), text
    assert changed > 1000


def test_plain_at_host_is_no_address():
    for text in ("meet me at example.com now", "john at example.com", "look at it. dot com is a word"):
        assert pii.added_spans(text, []) == []
