"""Exact dedup, fill-in-the-middle and importance resampling against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import exact_dedup as X
from leadflow.llm import fim, importance
from leadflow.llm.common import table

SPACE = re.compile(r"[\x20\x09-\x0D]")
ODD = [None, "", " \t\n", "a", "a ", " a", "A b\nc", "ünï ©ödé 中文 😀 x", "the cat " * 40, "x" * 5000, "one two three four\n" * 3, "\n\none\n \ntwo one\n\n",
       "é é   é", "<P> cut", "a<M>", "<", "<S<P <M", "x " * 120_000 + "\n" + "y" * 70_000, "<" * 50 + " <" * 50]
EXTRA = "_text string, keep_id string, _sha string, _row long, kept long, n string, form string, rank long, weight string, word string, _maybe string"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", 0, "c", "c", "c", 1, 2, "c", "c", 3, "c", "c", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def awkward(spark):
    """Odd texts, a row thrice, and rows without an id, two of them equal."""
    d = docs(spark, ODD)
    no_id = d.filter("doc_id in (3, 4, 7)").withColumn("doc_id", F.lit(None).cast("long"))
    return d.unionByName(d.filter("doc_id = 4")).unionByName(d.filter("doc_id = 4")).unionByName(no_id).unionByName(no_id)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- exact dedup ---------------------------------------------------------------

def brute_dedup(pairs):
    """(doc_id, keep_id, size, kept, sha) by dictionary; of rows equal in length and id one is kept."""
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("options", [{}, {"max_blocks": 0}, {"least_hot": 1}, {"least_hot": 2, "max_blocks": 0}])
def test_exact_dedup_awkward(spark, options):
    d = awkward(spark)
    got = X.exact_dedup(d, **options)
    assert rows(got, *COLS) == brute_dedup([(r.doc_id, r.text) for r in d.collect()])
    assert X.exact_dedup(d.limit(0), **options).count() == 0


def test_exact_dedup_hot_group_and_kept_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hot = spark.range(10_000, 13_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same text"), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int"))).alias("text"))
    d = d.select("doc_id", "text").unionByName(hot)
    got = X.exact_dedup(d, keep=["text"]).cache()
    pairs = [(r.doc_id, r.text) for r in d.collect()]
    assert rows(got, *COLS) == brute_dedup(pairs)
    assert rows(got, "doc_id", "text") == sorted(pairs, key=repr)
    with pytest.raises(ValueError):
        X.exact_dedup(d.withColumn("kept", F.lit(1)), keep=["kept"])


def test_exact_dedup_filter_has_no_false_negative_and_no_python(spark):
    d = spark.range(20_000).select(F.unhex(F.sha2((F.col("id") % 15_000).cast("string"), 256)).alias("sha"), "id")
    n_blocks = 20_000 * X.BITS_PER_ROW // X.BLOCK_BITS
    marked = X.mark_repeated(d, "sha", X.repeated_bits(d, "sha", n_blocks), n_blocks, True)
    c = marked.groupBy((F.col("id") % 15_000 < 5_000).alias("twice")).agg(F.count_if("_maybe").alias("hit"), F.count(F.lit(1)).alias("n")).collect()
    hits = {r.twice: (r.hit, r.n) for r in c}
    assert hits[True] == (10_000, 10_000)
    assert hits[False][0] < 0.1 * hits[False][1]              # the others nearly all pass straight through
    plan = X.exact_dedup(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"MapInArrow|MapInPandas|Python|CartesianProduct|NestedLoop", plan)


# --- fill in the middle ----------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_awkward(spark):
    d = awkward(spark)
    for shift in (0, 100, 200, 300):                      # other ids, other cuts and forms
        e = d.withColumn("doc_id", F.col("doc_id") + shift)
        made = fim.fill_in_middle(e, keep=["lang", "_text"])
        want = sorted((brute_fim(r.doc_id, r.text) for r in e.collect()), key=repr)
        assert rows(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == want
        back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
        assert rows(back, "doc_id", "text") == rows(e.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    assert fim.fill_in_middle(d.limit(0)).count() == 0


def test_fim_forms_on_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    made = fim.fill_in_middle(d)
    assert rows(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted((brute_fim(r.doc_id, r.text) for r in d.collect()), key=repr)
    forms = {r.form for r in made.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 64, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 30, n)
    places = np.concatenate(([0], np.cumsum(widths)))
    tokens = fim.SkipList(widths)
    ranks = range(n + 1) if n < 2000 else [0, 1, n // 3, n - 1, n]
    assert [tokens.place(r) for r in ranks] == [places[r] for r in ranks]
    assert n < 64 or len(tokens.units[1]) < n / 2
    for lane in range(1, len(tokens.units)):              # express lanes: fewer links, both widths add up
        assert len(tokens.units[lane]) <= len(tokens.units[lane - 1])
        assert tokens.chars[lane].sum() == places[tokens.units[lane].sum()]


def test_token_widths_any_text():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(" \t\n\x0b\x0c\r\x1f\x85 abcé中😀<") for _ in range(r.randrange(30)))
        assert fim.token_widths(text).tolist() == [len(t) for t in TOKEN.findall(text)]


# --- importance resampling ---------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)


def brute_resample(documents, targets, percent=25):
    s, t = collections.Counter(), collections.Counter()
    for _, x in documents:
        s.update(brute_features(x)[0])
    for x in targets:
        t.update(brute_features(x)[0])
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    out = []
    for i, x in documents:
        f, n = brute_features(x)
        gain = sum(math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + 10_000)) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


RANKED = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("percent", [25, 100])
def test_importance_awkward(spark, percent):
    d, target = awkward(spark), docs(spark, ["The cat, the CAT", None, "two\none two", ""])
    got = importance.resample(d, target, percent=percent)
    assert rows(got, *RANKED) == brute_resample([(r.doc_id, r.text) for r in d.collect()], [r.text for r in target.collect()], percent)
    assert importance.resample(d.limit(0), target).count() == 0
    assert rows(importance.resample(d, target.limit(0)), *RANKED) == brute_resample([(r.doc_id, r.text) for r in d.collect()], [])


def test_importance_on_documents(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = brute_resample([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()])
    assert rows(importance.resample(d, b), *RANKED) == want


def test_line_table_counts_alike_at_every_size(monkeypatch):
    r = random.Random(2)
    texts = ["\n".join(" ".join(r.choice(["a", "B", "c1", "é", "-", ""]) for _ in range(r.randrange(5))) for _ in range(r.randrange(6))) for _ in range(300)]
    want = collections.Counter(b for t in texts for b in brute_features(t)[0])
    table_ = importance.Lines(10_000)
    for every in (1, 7, 1000):
        counts = np.zeros(10_000, np.int64)
        for k, t in enumerate(texts):
            table_.add(t)
            if k % every == 0:
                table_.into(counts)
                table_.clear()
        table_.into(counts)
        table_.clear()
        assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)


def test_ranks_of_ties_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    got = importance.resample(d, d.limit(1), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 451))
    best = sorted(got, key=lambda r: (r["rank"] is None, r["rank"]))
    assert [r.score for r in best[:450]] == sorted((r.score for r in got), reverse=True)[:450]


# --- URL filter: list and filter sizes ----------------------------------------------

def test_url_list_decides_and_filter_is_sized_from_it(spark):
    from leadflow.llm import url_filter as U
    from leadflow.llm.queries import JUNK_HOST, URL_RULES
    pages = spark.range(6000).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") % 3 == 0, "https://www.free-bets.example.net/same#x")     # a third of all pages
        .otherwise(F.concat(F.lit("http://site"), (F.col("id") % 50).cast("string"), F.lit(".net/p"), F.col("id").cast("string"))).alias("url"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("site"), (F.col("id") % 50).cast("string"), F.lit(".net")).alias("host"),
                                            F.concat(F.lit("/p"), F.col("id").cast("string")).alias("path"))
    listed = listed.unionByName(spark.createDataFrame([("www.free-bets.example.net", "/same"), ("www.free-bets.example.net", "/same"), (None, "/x")], "host string, path string"))
    want = {i: i % 3 == 0 or (i < 3000 and i % 7 == 0) for i in range(6000)}
    for options in ({}, {"max_blocks": 0}, {"n_blocks": 1}):
        got = U.url_filter(pages, [U.Rule(*r) for r in URL_RULES], listed, **options).collect()
        assert {r.page_id: r.verdict == "block" for r in got} == want and len(got) == 6000
    bloom = U.bloom_filter(listed.dropna().withColumn("_key", U._url_key("host", "path")), "_key", 28)
    marked = U.mark_listed(pages.select(*[c.alias(n) for c, n in zip(U.canonical(F.col("url")), ("host", "path"))]), U._url_key("host", "path"), bloom, 28, True)
    assert marked.filter("_maybe").count() < 2800           # 2,286 are listed: few others reach the join
    hosts = {"spam-farm.example.org": True, "www.casino-win.example.com": True, "adsite.example.net": False, "x.example.net": False, "ads.example.net": True}
    shown = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", F.col("h").rlike(JUNK_HOST).alias("junk")).collect()
    assert {r.h: r.junk for r in shown} == hosts


# --- mixing: the ranking itself ---------------------------------------------------

def brute_mix(rows, weights=(5, 2, 1), repeats=3):
    """Copies of every (id, text, source) row by an ordering of each whole source."""
    import xxhash
    from leadflow.llm import mixing

    def row_hash(*parts):
        seed = 42
        for p in parts:
            if p is not None:
                seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed
    by_source = collections.defaultdict(list)
    for i, t, s in rows:
        by_source[s].append((i, t, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    goal = mixing.targets([(s, sum(m[2] for m in ms)) for s, ms in by_source.items()], weights, repeats)
    out = []
    for s, members in by_source.items():
        sizes = collections.Counter()
        for m in members:
            sizes[m[2].bit_length()] += m[2]
        lo, hi = 0.0, 64.0                              # the rate by bisection, not by the operator's formula
        expected = lambda rate, size: min(rate * min(1.0, (4 + size.bit_length()) / 16), repeats)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(expected(mid, c and (1 << (c - 1))) * n for c, n in sizes.items()) < goal[s] else (lo, mid)
        ranked, sure = [], 0
        for i, t, size in members:
            e = expected(hi, size)
            whole = math.floor(e + 1e-9)
            sure += whole * size
            p, h = max(e - whole, 0.0), row_hash(None if i is None else str(i), t)
            u = ((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)
            ranked.append(((u / (1 - u)) * ((1 - p) / p) if p > 1e-9 else math.inf, h, i, size, whole))
        upto, need = 0, goal[s] - sure
        for q, h, i, size, whole in sorted(ranked, key=lambda r: (r[0], r[1] - (1 << 64) if r[1] >> 63 else r[1])):
            upto += size
            out.append((i, size, whole + (q < math.inf and upto - size / 2 <= need)))
    return sorted(out, key=repr)


def test_mixing_equals_an_ordering_of_each_source(spark, sf_dir):
    from leadflow.llm import mixing
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))).alias("source"))
    d = d.unionByName(awkward(spark).select("doc_id", "text", F.lit("s1").alias("source")))
    got = mixing.mix(d).collect()
    assert sorted(((r.doc_id, r["size"], r.copies) for r in got), key=repr) == brute_mix([tuple(r) for r in d.collect()])
    assert len({r.copies for r in got}) > 1 and all(r.taken <= 3 * r["size"] for r in got)


# --- language ID: the kernel regression itself ---------------------------------------

def test_language_regression_equals_the_dense_kernel(spark):
    """Values of the folded model against kernels computed pair by pair and one dense ridge solution, also
    with more languages than landmarks and with a very long text."""
    from leadflow.llm import langid as L
    r = random.Random(4)
    words = {lang: ["".join(r.choice("abcdefghijklmnop"[k:k + 9]) for _ in range(r.randrange(2, 7))) for _ in range(40)] for k, lang in enumerate(["l1", "l2", "l3", "l4", "l5", "l6"])}
    texts = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(words) * 12)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    sample = {x.doc_id: x for x in L.training_sample(d, F.lit(False), 8).collect()}
    assert len(sample) == 48 and sorted(x.turn for x in sample.values()) == sorted(list(range(1, 9)) * 6)

    def kernel(a, b):
        return sum(len(np.intersect1d(x, y)) / math.sqrt(len(x) * len(y)) for x, y in zip(a, b) if len(x) and len(y)) / len(L.NGRAMS)
    grams = {i: L.presence(t) for i, t, _ in texts}
    probe = [grams[i] for i in range(0, 72, 5)] + [L.presence("abc " * 700_000)]
    names = sorted(words)
    for landmarks in (24, 4):
        model = L.train(d, F.lit(False), per_lang=8, landmarks=landmarks)
        order = spark.createDataFrame([(x.turn, x.lang, x.doc_id) for x in sample.values()], "turn int, lang string, doc_id long").orderBy("turn", F.xxhash64("lang"), "lang")
        marks = [grams[x.doc_id] for x in order.limit(landmarks).collect()]
        k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
        val, vec = np.linalg.eigh(k_mm)
        root = vec[:, val > 1e-8 * val.max()] / np.sqrt(val[val > 1e-8 * val.max()])
        ids = sorted(sample)
        phi = np.array([[kernel(grams[i], m) for m in marks] for i in ids]) @ root
        y = np.array([[1.0 if sample[i].lang == lang else -1.0 for lang in names] for i in ids])
        w = np.linalg.solve(phi.T @ phi + 0.1 * np.eye(phi.shape[1]), phi.T @ (y - y.mean(0)))
        want = np.array([[kernel(p, m) for m in marks] for p in probe]) @ root @ w
        assert model.langs == names and (model.then is None) == (landmarks > 6)
        assert np.allclose(model.scores(probe), want, atol=2e-3)
        assert set(model.least_margin) <= set(names)
    told = L.language_id(d).collect()
    assert sum(x.lang_pred == texts[x.doc_id][2] for x in told) > 68


def test_slices_of_long_texts_hold_all_n_grams(monkeypatch):
    from leadflow.llm import langid as L
    text = "".join(random.Random(1).choice("abc é中") for _ in range(5000))
    whole = L.presence(text)
    monkeypatch.setattr(L, "_SLICE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(L.presence(text), whole))


# --- quality rules: the verdict itself ---------------------------------------------

def brute_fences(values, spread=4.0):
    """{ratio: (low, high)} of a list of ratio rows, quantiles read off sorted bucket middles."""
    from leadflow.llm import quality as Q
    out = {}
    for k, (name, width) in enumerate(Q.RATIOS.items()):
        xs = sorted(0.0 if v[k] == 0 else Q.GAMMA ** math.ceil(math.log(v[k]) / math.log(Q.GAMMA)) * 2 / (Q.GAMMA + 1) for v in values)
        d1, q1, q3, d9 = (xs[-(-len(xs) * p // 20) - 1] for p in (2, 5, 15, 18))
        half = q3 - q1
        reach = lambda tail: max((half if half > 0 else tail) * spread, width)
        out[name] = (q1 - reach(q1 - d1) if name in Q.TWO_SIDED else -math.inf, q3 + reach(d9 - q3))
    return out


def test_quality_verdicts_equal_sorted_quantiles(spark, sf_dir):
    from leadflow.llm import quality as Q
    d = table(spark, sf_dir, "documents").unionByName(awkward(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("odd").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in d.collect()]
    judged = []
    for i, lang, source, text in rows:
        n, chars, symbols, dup, repeat = Q.features(text)
        lines = sum(1 for x in (text or "").split("\n") if x.split(" ") and re.search(r"[^\x20\x09-\x0D]", x))
        ratios = (chars * 1000 // max(n, 1), symbols * 1000 // max(n, 1), dup * 1000 // max(lines, 1), repeat * 1000 // max(n, 1))
        judged.append((i, lang, source, ratios, n < 50 or 100 * repeat > 50 * n))
    good = [j for j in judged if not j[4]]
    whole = brute_fences([j[3] for j in good])
    per_lang = {lang: ([j for j in good if j[1] == lang]) for lang in {j[1] for j in good}}
    per_group = {g: [j for j in good if j[1:3] == g] for g in {j[1:3] for j in good}}

    def fence(lang, source, name, side):
        def blend(members, wider):
            if not members:
                return wider
            own = brute_fences([m[3] for m in members])[name][side]
            return wider if math.isinf(wider) else (len(members) * own + 200 * wider) / (len(members) + 200)
        of_lang = blend(per_lang.get(lang), whole[name][side])
        return (min if side else max)(blend(per_group.get((lang, source)), of_lang), of_lang)
    memo = {(lang, source): {n: (fence(lang, source, n, 0), fence(lang, source, n, 1)) for n in Q.RATIOS} for _, lang, source, _, _ in judged}
    want = sorted(((i, not failed and all(memo[lang, s][n][0] <= v <= memo[lang, s][n][1] for n, v in zip(Q.RATIOS, ratios))) for i, lang, s, ratios, failed in judged), key=repr)
    got = rows_of = sorted(((r.doc_id, r.kept) for r in Q.quality_rules(d).collect()), key=repr)
    assert got == want and {k for _, k in rows_of} == {True, False}


# --- chat: positions and attention ----------------------------------------------------

@pytest.mark.parametrize("conversations, chars", [(512, 1 << 18), (7, 1 << 18), (512, 300), (1, 1)])
def test_chat_positions_and_intervals(spark, monkeypatch, conversations, chars):
    """A token's position is its place in its own conversation, and a leaf attends to exactly its conversation's
    text; a turn shared by very many conversations is written once a task, over all packs."""
    from leadflow.llm import chat
    monkeypatch.setattr(chat, "PACK_CONVERSATIONS", conversations)
    monkeypatch.setattr(chat, "PACK_CHARS", chars)
    r = random.Random(8)
    first = "you help <kindly> \\ always " * 40
    rows = []
    for c in range(90):
        turns = [("system", first)] + [(r.choice(["user", "assistant"]), r.choice(["a", "b", "", "<turn x>", "y" * 50])) for _ in range(r.randrange(6))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    said, texts = collections.defaultdict(list), collections.defaultdict(list)
    for c, k, role, text in sorted(rows):
        said[c].append(chat.format_turn(role, text))
        texts[c].append((role, text))
    whole = {c: "".join(v) for c, v in said.items()}
    packed = chat.packs(df).cache()
    packs = {p.pack_id: p for p in packed.collect()}
    tasks = {i >> 32 for i in packs}
    if (conversations, chars) != (512, 1 << 18):
        assert len(packs) > 1.5 * len(tasks)

    def turn(p, n):
        return p.text[p.node_start[n]:p.node_start[n] + p.node_length[n]]
    seen, written = set(), collections.Counter()
    for p in packs.values():
        assert len(set(p.node_start)) == len(p.node_start) and sum(p.node_length) == len(p.text)
        written.update((p.pack_id >> 32, turn(p, n)) for n in range(len(p.node_start)) if turn(p, n).startswith("<turn system>"))
        base = [turn(packs[b.pack], b.node) for b in p.base]
        assert all(b.pack < p.pack_id and b.pack >> 32 == p.pack_id >> 32 for b in p.base)
        for conv, leaf, depth in zip(p.conv_ids, p.leaves, p.conv_base):
            spans = [] if leaf < 0 else [tuple(x) for x in p.node_attends[leaf]] + [(p.node_start[leaf], p.node_start[leaf] + p.node_length[leaf])]
            assert "".join(base[:depth] + [p.text[a:b] for a, b in spans]) == whole[conv]
            place = sum(map(len, base[:depth]))
            for n in sorted((n for n, s in enumerate(p.node_start) if any(a <= s < b for a, b in spans)), key=lambda n: p.node_start[n]):
                assert p.node_position[n] == place and p.node_base[n] == depth
                place += p.node_length[n]
            assert place == len(whole[conv])
            seen.add(conv)
    assert seen == set(range(90)) and len(written) == len(tasks) and set(written.values()) == {1}
    back = {x.conv_id: x for x in chat.read_back(packed).collect()}
    for c, turns in texts.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = back[c]
        assert (x.n_turns, x.loss_chars, x.formatted_chars) == (len(turns), len(loss), len(whole[c]))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- LM: probabilities and gradients -----------------------------------------------

def test_lm_probabilities_and_gradient_step_by_hand():
    from leadflow.llm import lm
    rng = np.random.default_rng(3)
    totals = rng.integers(1, 500, lm.BUCKETS).astype(float)
    flat = (rng.standard_normal(lm.SIZE) * 0.1).astype(np.float32)
    toks, lens = rng.integers(0, lm.BUCKETS, 40).astype(np.uint16), np.array([17, 1, 22], np.int32)
    weights = lm.MaxEnt(totals, flat.copy()).t

    def history(at):
        start = max(s for s in (0, 17, 18) if s <= at)
        prev = int(toks[at - 1]) if at > start else lm.START
        skip = int(toks[at - 2]) if at > start + 1 else lm.START
        return prev, skip, (prev * 40503 + skip * 30011) % lm.PAIRS

    def softmaxes(at):
        prev, skip, pair = history(at)
        cls = int(toks[at]) // lm.MEMBERS
        t = totals.reshape(lm.CLASSES, lm.MEMBERS)
        a = [math.log(t[c].sum()) + weights["class_prev"][prev, c] + weights["class_skip"][skip, c] + weights["class_pair"][pair, c] for c in range(lm.CLASSES)]
        b = [math.log(t[cls, m]) + weights["member_prev"][prev * lm.CLASSES + cls, m] + weights["member_skip"][skip * lm.CLASSES + cls, m] for m in range(lm.MEMBERS)]
        soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
        return cls, soft(a), soft(b)
    got = lm.MaxEnt(totals, flat.copy()).log_prob(toks, lens)
    want = [math.log(a[c]) + math.log(b[int(toks[i]) % lm.MEMBERS]) for i in range(40) for c, a, b in [softmaxes(i)]]
    assert np.allclose(got, want, atol=1e-4)
    # One step: the gradient of a feature's uses, divided by their number plus the damping.
    learned = lm.MaxEnt(totals, flat.copy())
    learned.learn(toks, lens)
    step = {name: collections.defaultdict(lambda: [0, 0.0]) for name, *_ in lm.SHAPES}
    for i in range(40):
        prev, skip, pair = history(i)
        cls, a, b = softmaxes(i)
        ga, gb = np.array(a), np.array(b)
        ga[cls] -= 1
        gb[int(toks[i]) % lm.MEMBERS] -= 1
        for name, f, g in (("class_prev", prev, ga), ("class_skip", skip, ga), ("class_pair", pair, ga),
                           ("member_prev", prev * lm.CLASSES + cls, gb), ("member_skip", skip * lm.CLASSES + cls, gb)):
            step[name][f][0] += 1
            step[name][f][1] = step[name][f][1] + g
    for name, *_ in lm.SHAPES:
        want = weights[name].copy()
        for f, (uses, g) in step[name].items():
            want[f] -= lm.STEP * g / (uses + lm.DAMP)
        assert np.allclose(learned.t[name], want, atol=1e-4)


# --- pipeline: what it leaves behind ------------------------------------------------

def test_pipeline_returns_ids_and_leaves_one_scratch_table(spark, sf_dir):
    import os

    import corpus_pipeline
    from leadflow.llm.common import noted
    from leadflow.session import local_path
    with noted() as paths:
        out = corpus_pipeline.run(spark, sf_dir)
    rows_ = out.collect()
    assert rows_ and all(r.n_tokens == len(r.ids) and hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in rows_)
    assert len(paths) > 8 and [p for p in paths if os.path.exists(local_path(p))] == [p for p in paths if "llm-stage-3" in p]
