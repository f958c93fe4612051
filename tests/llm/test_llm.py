"""The dealt operators against brute force, and their edge cases: nulls, empty and long
texts, ties and repeated rows, empty tables, further columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from leadflow.llm import chat, embed_dedup, langid, lm, mixing, piece_codec, piece_count, quality, simhash, url_filter
from leadflow.llm.common import slices, table
from leadflow.llm.components import components
from leadflow.llm.queries import URL_RULES, _model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "a", "A b\nc", "ünï ©ödé 中文 😀 x", "# * $ % & | < >", "the cat " * 40, "x" * 5000, "one two three four\n" * 3,
       "é́ ﬁ ▁ <s> </s> <0x0A>", "  two  spaces "]
EXTRA = "_text string, s string, key string, fp long, a long, b long, word string"


def docs(spark, texts, langs=("en", None), sources=("s1", None, "s2"), first=0):
    rows = [(first + i, t, langs[i % len(langs)], sources[i % len(sources)], 0, "clash", "clash", "clash", 1, 2, 3, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def awkward(spark):
    """Odd texts, a repeated row and a null id."""
    d = docs(spark, ODD)
    return d.unionByName(d.filter("doc_id = 4")).unionByName(d.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return table(spark, sf_dir, "documents").limit(80).collect()


OPERATORS = {
    "codec": lambda d: piece_codec.digests(d, _model()), "encode": lambda d: piece_codec.encode(d, _model()), "count": lambda d: piece_count.token_counts(d, _model()),
    "simhash": simhash.simhash_components, "langid": langid.language_id, "mix": mixing.mix, "quality": quality.quality_rules, "lm": lm.lm_scores,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_and_empty_tables(spark, name):
    d = awkward(spark)
    got = OPERATORS[name](d).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r.doc_id is None, r.doc_id or 0) for r in d.select("doc_id").collect())
    assert OPERATORS[name](d.limit(0)).count() == 0


def test_url_rules_and_list(spark):
    urls = [None, "", "no-scheme", "http://A.Org/x?q", "https://x.example.org/es/1", "https://example.org/en/12#t", "https://notexample.org/en/1", "ftp://x.com/fr/", "http://com/de/x",
            "http://a.net/p", "http://a.net/p?q=1", "http://a.net/q", "http://a.org", "http://a.org?x/y", "://h/p", "http://a.com\n/fr/"]
    d = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(urls)] + [(3, urls[3], "c", "c")], "page_id long, url string, host string, block string")
    listed = spark.createDataFrame([("a.net", "/p")], "host string, path string")
    rules = [url_filter.Rule(*r) for r in URL_RULES]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        return (host, path, best and best.host + best.path, best.verdict if best else "block" if (host, path) == ("a.net", "/p") else "allow")
    for n_blocks in (1, 1 << 16):  # a full filter only passes more to the exact join
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(d, rules, listed, n_blocks).collect()), key=str)
        assert got == sorted(((i, *judge(u)) for i, u in [*enumerate(urls), (3, urls[3])]), key=str)
    assert url_filter.url_filter(d.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.url_filter(d, [], listed.limit(0)).collect()} == {"allow"}


def test_tokens_equal_the_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=_model())
    t, c = piece_codec.prefix_table(_model()), piece_count.counter(_model())
    rnd = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "▁", "é", "中", "😀", "\t", ".", "\x00", "==", "0", "ﬁ"]
    texts = [x or "" for x in ODD] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 20))) for _ in range(500)] + ["the" * 5000, " " * 4000]
    for x in texts:
        ids = sp.encode(x, add_eos=True)
        assert t.encode(x) == ids and c.count(x) == len(ids) - 1 and t.decode(ids) == sp.decode(ids)


def test_pair_tests_equal_merging_again():
    """Tokens that meet in texts, and others, against merges of their joined text."""
    t, rnd = piece_codec.PrefixTable(_model()), random.Random(5)
    used = [i for i in range(t.size) if t.lens[i]]
    pairs = [(rnd.choice(used), rnd.choice(used)) for _ in range(5000)]
    for _ in range(2000):
        word = "▁" * rnd.randint(0, 2) + "".join(t.texts[rnd.choice(used)].strip("▁") for _ in range(3))
        ids = [t.ids[x] for x in t.merged(word) if x in t.ids]
        pairs += zip(ids, ids[1:])
    want = [t.merged(t.texts[a] + t.texts[b]) == [t.texts[a], t.texts[b]] for a, b in pairs]
    assert [t.compatible(a, b) for a, b in pairs] == want and any(want) and not all(want)


def test_memory_of_workers_is_bounded(monkeypatch):
    """Ids are the same however little is remembered, and what is remembered stays within its bounds."""
    monkeypatch.setattr(piece_codec.PrefixTable, "CHUNKS", 40)
    monkeypatch.setattr(piece_codec.PrefixTable, "PAIRS", 30)
    t, rnd = piece_codec.PrefixTable(_model()), random.Random(6)
    made = []
    t.memo.make = lambda c: made.append(c) or t.encode_chunk(c)
    for k in range(300):
        text = "the of " + " ".join("".join(rnd.choice("abcdeinorst中é") for _ in range(rnd.randint(1, 9))) for _ in range(8))
        assert t.encode(text) == t.pieces.model.encode(text, add_eos=True)
        assert len(t.memo) + len(t.memo.aside) <= 40 and len(t.fits) <= 30
    assert made.count("▁of") == 1  # what keeps coming back is not worked out again


def test_workers_return_small_batches(spark):
    """Rows leave a worker in batches far below those it gets, and kept texts are sent once."""
    n = 1000
    d = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"),
                                       F.lit("en").alias("lang"), F.lit("s").alias("source"))

    model = langid.Model([], None)
    for out in (piece_codec.digests(d, _model(), with_ids=True), piece_codec.encode(d, _model()), quality.with_features(d, d.columns),
                langid.predict(d, model, d.columns), simhash.with_fingerprints(d, d.columns)):
        assert out.count() == n and sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(n))
    for out in (quality.with_features(d, d.columns), langid.predict(d, model, d.columns), simhash.with_fingerprints(d, d.columns)):
        assert [r.text for r in out.orderBy("doc_id").collect()] == [r.text for r in d.orderBy("doc_id").collect()]
        assert "_text" not in out._jdf.queryExecution().optimizedPlan().toString()
    whole = pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"])
    assert [b.num_rows for b in slices(whole)] == [256, 256, 256, 232] and pa.Table.from_batches(slices(whole)).column(0).to_pylist() == list(range(n))


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


def test_simhash_against_brute_force(spark, some):
    texts = [*ODD, *[r.text for r in some]]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark, texts)).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    groups = brute_groups(list(range(len(fp))), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    assert got == {i: (f"{f:016x}", g) for i, (f, g) in enumerate(zip(fp, groups))}


def test_links_of_a_hot_bucket_are_cut_into_tiles(spark, monkeypatch):
    """Fingerprints a few bits apart share buckets; small tiles must lose no link."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for b in base for _ in range(60)})
    fps = [f & (1 << 64) - 1 for f in fps]
    d = spark.createDataFrame([(f - (f >> 63 << 64), i) for i, f in enumerate(fps)], "fp long, rep long")
    groups = brute_groups(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = dict.fromkeys(range(len(fps)))
    got.update({r.node: r.component for r in components(simhash.links(d)).collect()})
    assert [i if got[i] is None else got[i] for i in range(len(fps))] == groups


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_on_held_out(spark, sf_dir):
    rows = langid.language_id(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert [langid.has_letter(t) for t in (None, "", "½ ² Ⅷ 3 _ ©", "3é", "中", "ﬁ")] == [False, False, False, True, True, True]
    odd = {r.doc_id: r.lang_pred for r in langid.language_id(docs(spark, ODD)).collect()}
    assert {odd[i] for i in (0, 1, 2, 6)} == {"und"} and odd[3] == "en"


def test_language_sample_takes_an_id_once_and_every_language(spark):
    rows = [(1, "same text", "a")] * 30 + [(1, "other text", "a")] + [(i, f"word {i}", "a") for i in (2, 3)]
    rows += [(i, "drei", "d") for i in (20, 21)] + [(i, "zwei", "c") for i in (10, 11)] + [(30, "uno", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sorted((r.lang, r.doc_id) for r in langid.training_sample(d, F.lit(False), 3).collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 30), ("c", 10), ("c", 11), ("d", 20), ("d", 21)]
    assert langid.train(d, F.lit(False), per_lang=3).langs == ["a", "b", "c", "d"]


def test_mix_targets_and_sizes(spark, some):
    d = docs(spark, [*ODD, *[r.text for r in some]])
    rows = mixing.mix(d).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate([*ODD, *[r.text for r in some]])}
    by, target = collections.Counter(), {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        s = ("s1", None, "s2")[r.doc_id % 3]
        by[s] += r.taken
        target[s] = r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(abs(by[s] - target[s]) <= max(size.values()) for s in target)
    # Many rows without an id are no single tie: some of each source are taken, some not.
    loose = mixing.mix(d.withColumn("doc_id", F.lit(None).cast("long"))).filter("size >= 50 and copies < 3").groupBy("source_size").agg(F.countDistinct("copies").alias("k"))
    assert loose.agg(F.max("k")).first()[0] > 1
    assert mixing.targets([("b", 10), ("a", 10), (None, 100)]) == {"a": 30.0, "b": 30.0, None: 60.0}


def test_quality_counts(spark, some):
    texts = [*ODD, *[r.text for r in some]]
    for r in quality.quality_rules(docs(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often = {x for x, n in collections.Counter(three).items() if n > 1}
        covered = {i + k for i, x in enumerate(three) if x in often for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.base_failed and r.kept)


def test_quality_sketches_are_close_and_merge(spark):
    rng = np.random.default_rng(2)
    x = {r: (rng.lognormal(7, 2, 4000) * (rng.random(4000) > 0.2)).astype(int) for r in quality.RATIOS}
    d = spark.createDataFrame([(i % 2, *map(int, v)) for i, v in enumerate(zip(*x.values()))], "g int, " + ", ".join(f"{r} long" for r in x))
    one = quality.quantile_sketch(d, [])
    merged = quality.quantile_sketch(d, ["g"]).groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, merged.collect()))
    assert one.groupBy("ratio").count().agg(F.max("count")).first()[0] < 2000
    low = quality.value_of(quality.bucket_of(F.col("v")))
    assert all(abs(r.got - r.v) <= 0.0101 * r.v for r in spark.range(0, 10**12, 10**9 + 7).unionAll(spark.range(3000)).select(F.col("id").alias("v"), low.alias("got")).collect())
    fence = quality.fences(one.withColumn("one", F.lit(1)), ["one"], 4.0).first()
    for r, width in quality.RATIOS.items():
        q1, q3 = (np.sort(x[r])[math.ceil(4000 * q) - 1] for q in (0.25, 0.75))
        assert math.isclose(fence[f"high_{r}"], q3 + max(4 * (q3 - q1), width), rel_tol=0.03)


def test_quality_rejects_junk_and_keeps_clean(spark):
    rnd = random.Random(2)
    clean = [" ".join(rnd.choice("alpha beta gamma delta word other thing place never under".split()) + str(rnd.randrange(999)) for _ in range(120)) for _ in range(300)]
    junk = [t.replace(" ", "### ") for t in clean[:10]]
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs(spark, clean + junk, langs=("en",), sources=("s",))).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 310))


def test_quality_fences_of_a_source_that_is_mostly_junk(spark):
    rnd = random.Random(7)

    def prose(lines=0):
        text = [rnd.choice("alpha beta gamma delta word other thing place never under".split()) + str(rnd.randrange(999)) for _ in range(120)]
        return "\n".join([*(" ".join(text[i:i + 12]) for i in range(0, 120, 12)), *[text[0]] * lines])

    clean = [prose() for _ in range(600)]
    dirty = [prose().replace(" ", " # ") for _ in range(150)]  # a symbol a word, and 60 % of its source
    lines = [prose(lines=8) for _ in range(20)]  # 8 of 18 lines repeat one
    texts = [*clean, *dirty, *lines]
    source = ["s"] * 500 + ["j"] * 250 + ["s"] * 20
    d = spark.createDataFrame([(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, source))], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_rules(d).collect()}
    assert [got[i] for i in range(len(texts))] == [True] * 600 + [False] * 170


def test_quality_fences_of_a_flat_middle_half_use_the_tail(spark):
    """Nine in ten values from 0 to 40, three in four 0: the spread acts on the outer tenth."""
    rows = [(1, r, int(b), n) for r in quality.RATIOS for b, n in zip((-1, *(spark.range(1).select(quality.bucket_of(F.lit(40))).first())), (80, 20))]
    fence = quality.fences(spark.createDataFrame(rows, "one int, ratio string, bucket int, n long"), ["one"], 20.0).first()
    assert math.isclose(fence.high_repeats, 800, rel_tol=0.02) and math.isclose(fence.high_symbols, 800, rel_tol=0.02)


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 24))
    x = [b + rng.standard_normal(24) * s for b in base for s in (0, 0, 0.05, 0.1, 0.14, 0.16)] + [base[0] + rng.standard_normal(24) * 0.03 for _ in range(60)]
    rows = [(i, [float(np.float32(v)) for v in e], i % 2) for i, e in enumerate(x)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + i, e, 0) for i, e in enumerate(odd)] + [(2000, rows[0][1], None)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, key long, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(d).collect()}
    e = np.array([r[1] for r in rows[:len(x)]])
    unit = e / np.linalg.norm(e, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(link, False)
    groups = brute_groups(list(range(len(x))), lambda i, j: link[i, j])
    want = {i: (int(link[i].sum()), groups[i], groups[i] == i) for i in range(len(x))}
    want.update({r[0]: (0, r[0], True) for r in rows[len(x):]})
    assert got == want and embed_dedup.embedding_dedup(d.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [3, 12, 20, 64])
def test_hot_cells_are_divided_without_losing_links(spark, monkeypatch, dim):
    """Spread vectors, which the further levels part, and near copies, which only salt does."""
    monkeypatch.setattr(embed_dedup, "TILE", 8)
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    x = np.concatenate([base, base * 3, base + rng.standard_normal((60, dim)) * 0.08, base[0] + rng.standard_normal((40, dim)) * 0.02])
    d = spark.createDataFrame([(i, [float(v) for v in e], "l") for i, e in enumerate(x)], "vec_id long, embedding array<double>, label string")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    groups = brute_groups(list(range(len(x))), lambda i, j: link[i, j])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_dedup(d).collect()}
    assert got == {i: (int(link[i].sum()), g) for i, g in enumerate(groups)}


def test_lm_base_and_model(spark, some):
    texts = [*ODD, *[r.text for r in some]]
    tok = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [" "] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = collections.Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    rows = lm.lm_scores(docs(spark, texts)).collect()
    for r in rows:
        t = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    m = lm.MaxEnt(rng.integers(1, 50, lm.BUCKETS).astype(float), rng.standard_normal(lm.SIZE).astype(np.float32))
    every = np.arange(lm.BUCKETS).astype(np.uint16)
    p = [np.exp(m.log_prob(np.array([7, 3, b], np.uint16), np.array([3]))[-1]) for b in every]
    assert abs(sum(p) - 1) < 1e-4


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PACK_CONVERSATIONS", 3)
    talks = {1: [("user", "hi"), ("assistant", "yo")], 2: [("user", "hi"), ("assistant", "no\\<turn user>\n")], 3: [("user", "hi"), ("assistant", "yo")],
             4: [("system", ""), ("user", chat.PROBE_TEXT), ("assistant", "</turn>\n<turn assistant>\nx</turn>\n")], 5: [("us<er>\\", "a\\b"), ("assistant", "")], None: [("user", "null id")], 7: [("r\na", "b")], 8: [("r", "a\nb")], 9: [("user", "<" * 20000 + "\\" * 20001 + "long " * 40000)]}
    rows = [(k, i, r, t, 0) for k, v in talks.items() for i, (r, t) in enumerate(v)] + [(6, 0, None, None, 0)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path int")
    packed = chat.packs(d)
    got = {r.conv_id: r for r in chat.read_back(packed).collect()}
    assert set(got) == {*talks, 6}
    for k, v in {**talks, 6: [("", "")]}.items():
        said = "".join(t for r, t in v if r == "assistant")
        r = got[k]
        assert (r.n_turns, r.turns_sha256) == (len(v), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)) for a, b in v)
    one = chat.packs(d.filter("conv_id in (1, 2, 3)").coalesce(1))
    assert sum(r.text.count("<turn user>\nhi") for r in one.collect()) == one.count()  # the shared turn is emitted once a pack
    assert chat.packs(d.limit(0)).count() == 0


def brute_pipeline(rows):
    kept = [r for r in rows if r["kept"] and langid.has_letter(r["text"])]
    fp = [brute_fingerprint(r["text"]) for r in kept]
    ids = [r["doc_id"] for r in kept]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    groups = brute_groups([ids[i] for i in order], lambda a, b: (fp[order[a]] ^ fp[order[b]]).bit_count() <= 3)
    return {ids[i] for i, g in zip(order, groups) if ids[i] == g}


def test_pipeline_against_brute_force(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(d).collect()}
    whole = [{**r.asDict(), "kept": kept[r.doc_id]} for r in d.collect()]
    left = brute_pipeline(whole)
    at = d
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, sf_dir).select(*corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in at.select("doc_id").collect()} == left
    copies = {r.doc_id: r.copies for r in mixing.mix(at).collect() if r.copies}
    out = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    codec = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in piece_codec.digests(d, _model()).collect()}
    assert out == collections.Counter({(i, *codec[i]): n for i, n in copies.items()})


def test_pipeline_stages_on_awkward_and_empty_tables(spark, sf_dir):
    for start in (awkward(spark), awkward(spark).limit(0)):
        at = start
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf_dir)
            at.count()
            assert stage(spark, start, sf_dir).count() >= 0


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    """1 and 3 are linked through a null id only; 5 has two unlinked texts, which do not join 6 and 7."""
    monkeypatch.setattr(simhash, "fingerprints", lambda d, shingle: d.select("doc_id", F.col("text").cast("long").alias("fp")))
    far, other = 0x0F0F0F << 40, 0x333333 << 8
    rows = [(1, 0), (None, 0b111), (3, 0b111111), (5, far), (6, far + 1), (5, other), (7, other + 1), (None, -1)]
    d = spark.createDataFrame([(i, str(f)) for i, f in rows], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.simhash_components(d).collect())
    assert got == collections.Counter([(1, 1), (None, 1), (3, 1), (5, 5), (6, 5), (5, 5), (7, 5), (None, None)])
    groups = {r.fp: r.group for r in simhash.fingerprint_groups(d.select(F.col("text").cast("long").alias("fp"))).collect()}
    assert groups[far] == groups[far + 1] != groups[other] == groups[other + 1]


def test_near_dedup_keeps_one_row_of_each_group(spark, sf_dir):
    rnd = random.Random(5)
    a, b, c, e = (" ".join(str(rnd.randrange(10**6)) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (2, b), (None, b), (2, c), (2, c), (None, e)]  # one id over b and c; a and e have none
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, d, sf_dir).collect())
    assert got == collections.Counter([(None, a), (2, b), (2, c), (None, e)])
