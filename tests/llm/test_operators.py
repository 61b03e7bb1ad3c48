"""Each operator against a plain version on a small corpus, and on an empty table."""

import collections
import hashlib
import math
import pickle
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus
import corpus_pipeline

from brook.llm import exact_dedup as exact
from brook.llm.common import split_join, spread_join
from brook.llm.components import components
from brook.llm.language_model import lm_score
from brook.llm.license_scan import TEMPLATES, license_scan, similarity_join, template_words
from brook.llm.line_dedup import line_dedup
from brook.llm.mixing import mix, rake
from brook.llm.ngram_join import keys_of_set, ngram_join
from brook.llm.packing import Chunks, pack, plan
from brook.llm.quality_rules import RATIOS, base_failed, decision_list, features, quality_rules, verdict
from brook.llm.quality_rules import learn as learn_rules
from brook.llm.queries import tokenizer_path
from brook.llm.suffix_dedup import suffix_dedup
from brook.llm.text_bytes import word_hashes
from brook.llm.toxicity import INSULT, KINDS, PRIOR, REST, TARGET, WORDS, Grammar, Reader, cascade, composed, machine, toxicity
from brook.llm.toxicity import probability as toxic_probability

LAST = 9223372036854775807
WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    found = [(i, int("spam" not in (t or "")), int(bool(re.search("idiot|clown|scum", t or "")))) for i, t in corpus.texts() if i is not None]
    return spark.createDataFrame([*found, (999_999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def got(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def pairs():
    return [(i, LAST if i is None else i, t or "") for i, t in corpus.texts()]


def test_suffix_dedup(docs, empty):
    first: dict[bytes, int] = {}
    for _, d, t in pairs():
        b = t.encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    want = collections.Counter()
    for i, d, t in pairs():
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffix_dedup(docs), *columns) == want
    # every shared anchor dealt to groups of a tile or two
    assert got(suffix_dedup(docs.repartition(9), hot=1, group_tiles=1), *columns) == want
    assert suffix_dedup(empty).count() == 0


def test_ngram_join(docs, empty):
    rows = pairs()
    sets = []
    for _, _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {d: d for _, d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(rows[a][1]), find(rows[b][1])
                parent[max(x, y)] = min(x, y)
    back = lambda x: None if x == LAST else x
    want = collections.Counter((i, len(s), back(find(d))) for (i, d, _), s in zip(rows, sets))
    for rare in (8, 1):
        assert got(ngram_join(docs, rare=rare), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join(empty).count() == 0


def test_combination_keys_meet():
    """Any two similar sets share a key, whatever is rare."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        x = set(rng.choice(10_000, n, replace=False).tolist())
        y = set(list(x)[int(rng.integers(0, max(1, n // 5))) :]) | set(rng.choice(10_000, int(rng.integers(0, max(1, n // 8))), replace=False).tolist())
        if x == y or 100 * len(x & y) < 80 * len(x | y):
            continue
        df = {t: int(rng.integers(2, 20)) if t in x & y else 1 for t in x | y}
        keys = []
        for s in (x, y):
            order = sorted(s, key=lambda t: (df[t], t))
            keys.append(set(keys_of_set(np.array(order, dtype=np.uint64), np.array([df[t] for t in order]), 8).tolist()))
        assert keys[0] & keys[1]


def test_a_very_long_text(spark):
    """A text of 50 MB beside short ones that share passages with it."""
    parts = lambda a, b: F.array_join(F.transform(F.sequence(F.lit(a), F.lit(b)), lambda i: F.md5(i.cast("string"))), " ")
    texts = [(1, parts(1, 1_550_000)), (2, parts(700_000, 700_009)), (3, F.concat(F.lit("x" * 60), parts(1_549_990, 1_549_999)))]
    rows = None
    for i, t in texts:
        one = spark.range(1).select(F.lit(i).cast("long").alias("doc_id"), t.alias("text"))
        rows = one if rows is None else rows.union(one)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup(rows).collect()}
    assert found == {1: (51149999, 0), 2: (329, 329), 3: (389, 329)}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(rows).collect()}
    assert near == {1: (1549996, 1), 2: (6, 2), 3: (6, 3)}


def test_pieces_of_a_text_have_its_words():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abcdefgh  \n", dtype=np.uint8), 5000)
    whole, _ = word_hashes(data, np.array([0, len(data)]), 1 << 20)
    parts, _ = word_hashes(data, np.array([0, len(data)]), 300)
    assert (whole == parts).all()
    assert (word_hashes(np.full(5000, 97, dtype=np.uint8), np.array([0, 5000]), 300)[0] == word_hashes(np.full(5000, 97, dtype=np.uint8), np.array([0, 5000]))[0]).all()


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr("brook.llm.common.hot_from", lambda total: 50)
    rows = spark.createDataFrame([(7 if k < 200 else k % 40, k) for k in range(400)], "key long, did long")
    found = spark.createDataFrame([(k, k * 2, 200 if k == 7 else 5) for k in range(0, 30)], "key long, v long, n long")
    want = sorted((k, d, k * 2) for k, d in map(tuple, rows.collect()) if k < 30)
    assert sorted(map(tuple, split_join(rows, found, "key", 400).collect())) == want


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr("brook.llm.common.hot_from", lambda total: 50)
    rows = spark.range(500).selectExpr("id", "if(id < 300, -1, id % 40) as key").filter("key <> 7")
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("key") * 2).filter("key <> 8")
    out = spread_join(rows, found, "key", 500, F.xxhash64("id"))
    assert out.columns == ["id", "key", "v"]
    assert got(out, "id", "key", "v") == collections.Counter((r["id"], r["key"], r["key"] * 2) for r in rows.collect() if r["key"] != 8)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (95, 90), (7, 7), (100, 95)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_line_dedup(docs, empty):
    rows = pairs()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for least in (2, 4):
        held = collections.defaultdict(set)
        for _, d, t in rows:
            for line in t.split("\n"):
                held[key(line)].add(d)
        want = collections.Counter()
        for i, d, t in rows:
            ls = t.split("\n")
            kept = [x for x in ls if not (len(key(x)) >= 10 and len(held[key(x)]) >= least and min(held[key(x)]) < d)]
            want[(i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
        out = line_dedup(docs, min_docs=least).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
        assert got(out, "doc_id", "__n_lines", "__n_dropped", "sha") == want
    assert set(docs.columns) <= set(line_dedup(docs).columns)
    assert line_dedup(empty).count() == 0


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))], ids=["sha256", "many collisions"])
def test_exact_dedup(spark, docs, tmp_path, digest):
    path = docs.inputFiles()[0].rsplit("/", 1)[0]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = collections.defaultdict(list)
    for _, d, t in pairs():
        groups[norm(t)].append(d)
    back = lambda x: None if x == LAST else x
    want = collections.Counter((i, back(min(groups[norm(t)])), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, _, t in pairs())
    out = exact.exact_dedup(spark, path, digest=digest)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r for r in out.collect() if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_goes_on(spark, docs, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    docs.filter("doc_id < 50").write.parquet(path)
    one = exact.dedup_state(spark, path, state).count()
    docs.filter("doc_id >= 50 or doc_id is null").write.mode("append").parquet(path)
    two = exact.dedup_state(spark, path, state)
    assert one < two.count() and two.agg(F.sum("n")).first()[0] == docs.count()


def test_exact_dedup_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "none"))
    assert exact.exact_dedup(spark, str(tmp_path / "none")).count() == 0


def test_quality_features(docs, labels, empty):
    want = collections.Counter()
    for i, _, t in pairs():
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    out = quality_rules(docs, labels)
    assert got(out, "doc_id", "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed") == want
    assert out.filter("__kept and __base_failed").count() == 0
    assert quality_rules(empty, labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).filter("__kept = __base_failed").count() == 0
    assert features(docs).count() == docs.count()


def test_decision_list():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        r = {n: float(rng.random()) for n in RATIOS}
        r["bad"] = r["symbol_rate"] > 0.8 or r["repeat_rate"] > 0.7 and r["n_words"] < 0.5
        rows.append(r)
    rules = decision_list(rows)
    hit = [any(x.covers(r) for x in rules) for r in rows]
    right = sum(a and r["bad"] for a, r in zip(hit, rows))
    assert right >= 0.9 * sum(r["bad"] for r in rows) and right >= 0.98 * sum(hit)
    assert decision_list([]) == []


def test_quality_rules_at_a_small_size(spark):
    """The list is not empty, and the verdict is that of a plain reading of it."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = learn_rules(docs, labels)
    assert rules
    for r in quality_rules(docs, labels).drop("text").collect():
        values = {n: r["__" + n] for n in RATIOS}
        rule = next((k for k, x in enumerate(rules) if x.covers(values)), None)
        assert r["__rule"] == rule and r["__kept"] == (not r["__base_failed"] and rule is None)


def test_quality_rules_hold_for_other_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rules = learn_rules(docs, labels.filter(~other))
    met = features(docs).join(labels.filter(other & F.col("quality").isNotNull()).select("doc_id", "quality"), "doc_id").filter(~base_failed())
    n = {(r["quality"], r["gone"]): r["count"] for r in met.withColumn("gone", verdict(rules).isNotNull()).groupBy("quality", "gone").count().collect()}
    assert n[0, True] >= 0.9 * (n[0, True] + n.get((0, False), 0)) and n[0, True] >= 0.95 * (n[0, True] + n.get((1, True), 0))


def test_decision_list_goes_on_after_a_vague_rule():
    """Most bad rows look like good ones; the others have a mark of their own."""
    rng = np.random.default_rng(8)
    rows = [{n: float(rng.random()) for n in RATIOS} | {"bad": k < 120} for k in range(400)]
    for r in rows[:30]:
        r["symbol_rate"] = 2.0
    rules = decision_list(rows)
    assert all(any(x.covers(r) for x in rules) for r in rows[:30])


def test_labelled_sample_is_bounded(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("7L as doc_id", "concat('some words of the same text that go on and on up to ', id) as text")
    labels = spark.createDataFrame([(7, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr("brook.llm.quality_rules.decision_list", lambda rows, **k: seen.append(len(rows)) or [])
    assert quality_rules(docs, labels, max_labelled=1).count() == 2000 and seen == [1]


def test_columns_with_the_names_of_helpers_stay(spark, docs, labels):
    names = ["__key", "__pos", "__hash", "__did", "__th", "__s", "__l", "__t", "__w", "__lines", "__distinct", "__gone", "h", "first", "hot_", "weight", "probability", "id", "did"]
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")) for n in names})
    for out in (line_dedup(some), mix(some), quality_rules(some, labels), corpus_pipeline.near_copies(spark, some, "")):
        assert set(some.columns) <= set(out.columns)
        first = out.filter("doc_id = 3").first()
        assert all(first[n] == f"{n}3" for n in names)


def test_license_scan(docs, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want, met = collections.Counter(), collections.Counter()
    for i, _, t in pairs():
        w, at, labels = words.findall(lower(t)), [], set()
        for p, name in phrases.items():
            n = len(p.split())
            here = [k for k in range(len(w) - n + 1) if w[k : k + n] == p.split()]
            at += here
            labels |= {name} if here else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
        for b, line in enumerate(t.split("\n")):
            own = set(words.findall(lower(line)))
            for k, (_, text) in enumerate(TEMPLATES):
                ws = set(template_words(text))
                if len(own & ws) >= math.ceil(0.8 * len(ws) - 1e-9):
                    met[(i, b, k)] += 1
    out = license_scan(docs)
    assert got(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert out.filter("score < 0 or score > 1").count() == 0
    assert got(similarity_join(docs, ("doc_id",)), "doc_id", "block", "template") == met and met
    assert license_scan(empty).count() == 0


def test_lm_score(docs, empty):
    tokens = [(i, WORD.findall(lower(t)) + ["\0"]) for i, _, t in pairs()]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = collections.Counter(x for i, ws in tokens if not held(i) for x in ws)
    n, v = sum(c.values()), len(c)
    for known in (1 << 18, 20):
        rows = lm_score(docs, known_words=known).collect()
        want = collections.Counter((i, held(i), len(ws), sum(c[x] > 0 for x in ws), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws), 6)) for i, ws in tokens)
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
    assert lm_score(empty).count() == 0


def test_lm_is_normalised():
    from brook.llm.language_model import CLASSES, START, log_table, train

    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, CLASSES**3, 500))
    codes = codes[codes % CLASSES != START]
    table = log_table(train(codes, np.ones(len(codes)), steps=50)).reshape(-1, CLASSES)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_lm_scores_are_normalised_over_all_classes(spark, monkeypatch):
    """Scores against the whole softmax of the trained model, with and without several groups of contexts."""
    from brook.llm import language_model as lm

    rng, models = np.random.default_rng(5), []
    train_all = lm.train_all
    monkeypatch.setattr(lm, "train_all", lambda *a, **k: models.append(train_all(*a, **k)) or models[-1])
    text = lambda ks: " ".join(f"aa{k:02d} bb{k:02d}x" for k in ks) + rng.choice(["", " some rare.", " Äx"])
    texts = [text(rng.integers(0, 40, 60).tolist()) for _ in range(300)] + ["", "never seen"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    score = {r["doc_id"]: r["score"] for r in lm.lm_score(rows, least=100).collect()}
    (model,) = models

    split = [lower(t).encode().split() for t in texts]
    count = collections.Counter(w for k, ws in enumerate(split) if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    own = sorted((w for w in count if count[w] >= 100), key=lambda w: (-count[w], w))
    number = {w: k for k, w in enumerate(own)}
    form_of = lambda w: len(own) + lm.form(w)
    rare = [w for w in count if w not in number]
    whole = {f: sum(count[w] + 1 for w in rare if form_of(w) == f) + 1 for f in range(len(own), len(own) + lm.FORMS)}
    assert rare and len(own) > 50 and len(model["bias"]) == len(own) + lm.FORMS + 2
    m = {k: v.astype(float) for k, v in model.items()}
    for k, words in enumerate(split):
        one = two = len(own) + lm.FORMS + 1
        want = 0.0
        for w in [*words, None]:
            cls = len(own) + lm.FORMS if w is None else number.get(w, form_of(w))
            s = ((m["position"][0] * m["context"][one] + m["position"][1] * m["context"][two]) @ m["word"].T + m["bias"])[:-1]
            want += (s[cls] - math.log(np.exp(s).sum())) / math.log(10)
            if cls in whole:
                want += math.log10((count[w] + 1) / whole[cls])
            one, two = two, cls
        assert score[k] == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("length", [0.5, 40.0])
def test_normaliser_sums_every_class(length, monkeypatch):
    from brook.llm import language_model as lm

    monkeypatch.setattr(lm, "SUMMED", 7)
    monkeypatch.setattr(lm, "CONTEXTS", 11)
    rng = np.random.default_rng(2)
    model = lm.new_model(np.full(60, 1 / 60))
    model["word"] = rng.normal(0, length, model["word"].shape).astype(np.float32)
    model["context"] = rng.normal(0, length, model["context"].shape).astype(np.float32)
    model["bias"][-1] = 9  # a start never follows
    dense = [k for k in range(3600) if k // 60 == 3 or k % 60 == 8]  # words that meet all others
    for codes in (rng.integers(0, 3600, 200), np.unique([*dense, *rng.integers(0, 3600, 90)]), np.arange(3600), np.zeros(0, np.int64)):
        one, two = codes // 60, codes % 60
        q = (model["context"][one] + model["context"][two]).astype(float)
        want = np.logaddexp.reduce(q @ model["word"][:-1].T.astype(float) + model["bias"][:-1], axis=1)
        found = lm.log_sums(model["context"], model["context"], model["word"][:-1], model["bias"][:-1], one, two)
        assert np.allclose(found, want, rtol=1e-5, atol=1e-5)


def test_lm_levels_are_normalised(monkeypatch):
    """The chances of all classes after a context, from the sums of both levels and in a plain form; a class stands in one place."""
    from brook.llm import language_model as lm

    rng = np.random.default_rng(3)
    model = lm.new_model(rng.random(90))
    for name in ("word", "context"):
        model[name] = rng.normal(0, 1, model[name].shape).astype(np.float32)
    word, bias = model["word"][:-1].astype(float), model["bias"][:-1].astype(float)
    one, two = rng.integers(0, 90, 40), rng.integers(0, 90, 40)
    for alone, group, least in ((8, 5, 5), (0, 1, 5), (88, 1, 88), (89, 128, 89), (128, 128, 89)):
        monkeypatch.setattr(lm, "ALONE", alone)
        monkeypatch.setattr(lm, "GROUP", group)
        levels = lm.two_levels(model)
        assert b"brook" not in pickle.dumps(levels)  # it is broadcast to workers that may not have this package
        assert len(levels["upper"]) >= least and sorted(levels["place"]) == list(range(89))
        n = np.repeat(np.arange(40), 89)
        found = lm.log_chances(levels, model["context"], model["context"], one[n], two[n], np.tile(np.arange(89), 40)).reshape(40, 89)
        assert np.allclose(np.exp(found).sum(axis=1), 1, atol=1e-4)
        for k, (i, j) in enumerate(zip(one, two)):
            q = (model["context"][i] + model["context"][j]).astype(float)
            score, who = word @ q + bias, [np.flatnonzero(levels["group"] == g) for g in range(len(levels["upper"]))]
            upper = np.array([np.average(word[w], axis=0, weights=np.exp(bias[w])) @ q + np.log(np.exp(bias[w]).sum()) for w in who])
            upper -= np.logaddexp.reduce(upper)
            want = [upper[levels["group"][c]] + score[c] - np.logaddexp.reduce(score[who[levels["group"][c]]]) for c in range(89)]
            assert np.allclose(found[k], want, atol=1e-4)
            if least >= 88:  # nobody shares a group: the plain softmax
                assert np.allclose(found[k], score - np.logaddexp.reduce(score), atol=1e-4)


def test_lm_sums_the_root_of_the_classes(monkeypatch):
    from brook.llm import language_model as lm

    rng, terms, log_sums = np.random.default_rng(4), [], lm.log_sums
    model = lm.new_model(rng.random(20_000))
    monkeypatch.setattr(lm, "log_sums", lambda a, b, word, bias, one, two: terms.append(len(word) * len(one)) or log_sums(a, b, word, bias, one, two))
    one, two, target = rng.integers(0, 20_000, (3, 3000))
    lm.log_chances(lm.two_levels(model), model["context"], model["context"], one, two, np.minimum(target, 19_998))
    assert 0 < sum(terms) < 3000 * 6 * math.sqrt(20_000)


def test_lm_scores_of_grouped_words(spark, monkeypatch):
    """Scores of texts whose words stand in groups; one row a text goes on from the scoring tasks, and no others are dealt out."""
    from brook.llm import language_model as lm

    rng, models = np.random.default_rng(6), []
    train_all = lm.train_all
    monkeypatch.setattr(lm, "train_all", lambda *a, **k: models.append(train_all(*a, **k)) or models[-1])
    monkeypatch.setattr(lm, "ALONE", 12)
    monkeypatch.setattr(lm, "GROUP", 4)
    texts = [" ".join(f"w{k:02d}" for k in rng.integers(0, 90, 150)) for _ in range(150)] + [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = lm.lm_score(rows, held=F.lit(False), least=2)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    score, (model,) = {r["doc_id"]: r["score"] for r in out.collect()}, models
    count = collections.Counter(w for t in texts for w in t.split())
    number = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
    own, levels, m = len(number), lm.two_levels(model), {k: v.astype(float) for k, v in model.items()}
    assert own == 90 and len(levels["upper"]) > 14
    for k, text in enumerate(texts):
        classes, want = [own + lm.FORMS + 1] * 2 + [number[w] for w in text.split()] + [own + lm.FORMS], 0.0
        for one, two, cls in zip(classes, classes[1:], classes[2:]):
            q = m["position"][0] * m["context"][one] + m["position"][1] * m["context"][two]
            upper, s, same = levels["upper"] @ q + levels["upper_bias"], (m["word"] @ q + m["bias"])[:-1], levels["group"] == levels["group"][cls]
            want += upper[levels["group"][cls]] - np.logaddexp.reduce(upper) + s[cls] - np.logaddexp.reduce(s[same])
        assert score[k] == pytest.approx(want / math.log(10), abs=2e-3)


def test_toxicity(docs, labels, empty):
    out = toxicity(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    assert out.filter("toxic is not null and predicted <> toxic").count() == 0
    assert toxicity(docs, labels).count() == docs.count()
    assert toxicity(docs, labels.limit(0)).filter("score < 0 or score > 1").count() == 0
    assert toxicity(empty, labels).count() == 0


def test_toxicity_grammar():
    reader = Reader(Grammar(stems=("dumm",)))
    kinds = lambda s: {k: int(n) for k, n in zip(KINDS, reader.counts([s])[0]) if n}
    assert kinds("you are an idiot") == {"slur": 1, "aimed": 1}
    assert kinds("what an idiot") == {"slur": 1}
    assert kinds("idiot, he is here") == {"slur": 1}  # a target in another clause
    assert kinds("stupid you") == {"slur": 1, "aimed": 1}
    assert kinds("you are not an idiot") == {"denied": 1}
    assert kinds("he said you are an idiot") == {"quoted": 1}
    assert kinds("he was found in the trash") == {"slur": 1}  # a preposition ends the reach
    assert kinds("i will kill you") == {"threat": 1, "menace": 1}
    assert kinds("they never kill you") == {}
    assert kinds("dummheit") == {"slur": 1}
    assert kinds("Fine. You idiot! idiotic") == {"slur": 1, "aimed": 1}
    assert kinds("you " + "word " * 50 + "idiot") == {"slur": 1}
    assert len(PRIOR) == len(KINDS)


def test_toxicity_scores_clauses_not_words():
    reader = Reader(Grammar())
    score = lambda s: float(toxic_probability(reader.counts([s]), PRIOR)[0])
    for text in ("", "idiot", "Moron is the name of a town.", "He was found in the trash.", "You are not an idiot.", "She said he is an idiot.", "They kill time."):
        assert score(text) < 0.3
    for text in ("You are an idiot.", "You are a worthless idiot.", "I will kill you.", "the loser and his pathetic friends"):
        assert score(text) >= 0.3


def test_composed_transducers_write_what_the_cascade_writes():
    rng = np.random.default_rng(6)
    steps, one = cascade(), machine()
    pair = composed(steps[0], steps[2])
    for _ in range(500):
        read = rng.integers(0, WORDS, int(rng.integers(1, 25))).tolist()
        out = read
        for t in steps:
            out = t.run(out)
        assert one.run(read) == out
        assert pair.run(read) == steps[2].run(steps[0].run(read))
    # runs of words without a meaning are as good as REST of them
    assert all(one.run([x] + [0] * k + [TARGET, INSULT])[-2:] == one.run([x] + [0] * REST + [TARGET, INSULT])[-2:] for x in range(WORDS) for k in range(REST, REST + 4))


def test_toxicity_sample_is_bounded(spark):
    """Many rows of one id are one row of the sample."""
    docs = spark.range(2000).selectExpr("7L as doc_id", "concat('you are an idiot ', id) as text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert toxicity(docs, labels, max_labelled=1).filter("predicted = 1").count() == 2000


def test_toxicity_learns_on_held_out_rows(spark):
    """Precision and recall on the rows that were not learned from."""
    sf = "/root/testdata/sf0.1"
    out = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    met = out.join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic"), "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in met.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for capacity in (2048, 64):
        rows = pack(docs, tokenizer_path(), capacity=capacity).collect()
        want = collections.Counter()
        for i, _, text in pairs():
            ids = [*t.encode(text, add_special_tokens=False).ids, 0]
            for p, k in enumerate(range(0, len(ids), capacity)):
                own = ids[k : k + capacity]
                want[(i, p, k, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(by) <= math.ceil(sum(r["length"] for r in rows) / capacity) * 1.1 + 1
    assert pack(empty, tokenizer_path()).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(4)
    for _ in range(50):
        counts = collections.Counter(rng.integers(1, 101, int(rng.integers(1, 400))).tolist())
        made = plan(dict(counts), 100)
        used = collections.Counter()
        for times, lengths in made:
            assert times > 0 and sum(lengths) <= 100 and sum(3 * n > 100 for n in lengths) <= 2
            for n in lengths:
                used[n] += times
        assert used == counts
        assert sum(t for t, _ in made) <= 1.25 * sum(n * c for n, c in counts.items()) / 100 + 1 + sum(c for n, c in counts.items() if n > 50)
    assert plan({}) == []


def test_chunks_are_as_the_tokenizer():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(tokenizer_path()), Chunks(tokenizer_path())
    odd = ["Don't stop, it's 12.5% ÉCOLE", "naïve İstanbul ΣΑΣ éa", "<|endoftext|> a,b x.y!!", "日本語 ŸŸ", "", "...", "a b"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in odd]
    assert c.ids([x.encode() for x in odd]) == want


def test_mixing(spark, docs, empty):
    out = mix(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["__probability"] <= 1 for r in out)
    assert all(r["__kept"] for r in out if not (r["text"] or "").strip(" \t\n\x0b\x0c\r"))
    assert mix(empty).count() == 0
    many = spark.range(30_000).selectExpr("id as doc_id", "'a b c d e' as text", "if(id % 3 = 0, 'x', 'y') as source", "if(id % 5 < 2, 'en', 'de') as lang")
    kept = mix(many, source_targets={"x": 0.5, "y": 0.5}, lang_targets={"en": 0.7, "de": 0.3}).filter("__kept")
    share = lambda c, v: kept.filter(F.col(c) == v).count() / kept.count()
    assert abs(share("source", "x") - 0.5) < 0.02 and abs(share("lang", "en") - 0.7) < 0.02


@pytest.mark.parametrize("options", [{}, {"temper": 0.6}, {"temper": 0.6, "local_cells": 0}], ids=str)
def test_mixing_is_plain_proportional_fitting(docs, options):
    """Every document's probability and draw against a plain version."""
    rows = [r.asDict() for r in docs.collect()]
    space = re.compile(r"[\x20\x09-\x0D]+")
    words = lambda t: len([w for w in space.split(t or "") if w])
    about = lambda t: "notice" if "licen" in t.lower() else "table" if t.count("|") >= 5 else "list" if t.count("\n") >= 20 else "prose"
    cell = lambda r: (r["source"] or "(null)", r["lang"] or "(null)", about(r["text"] or ""))
    now = collections.Counter()
    for r in rows:
        now[cell(r)] += words(r["text"])
    before = {k: float(v) for k, v in now.items() if v}
    total, temper = sum(before.values()), options.get("temper", 0.97)
    flat = {k: (v / total) ** temper for k, v in before.items()}
    now = dict(before)
    for _ in range(400):
        for axis in range(3):
            for name in {k[axis] for k in now}:
                want = sum(v for k, v in flat.items() if k[axis] == name) / sum(flat.values()) * total
                have = sum(v for k, v in now.items() if k[axis] == name)
                now = {k: v * want / have if k[axis] == name else v for k, v in now.items()}
    most = max(v / before[k] for k, v in now.items())
    out = mix(docs, **options).collect()
    assert len(out) == len(rows)
    for r in out:
        p = now[cell(r.asDict())] / before[cell(r.asDict())] / most if words(r["text"]) else 1.0
        drawn = int(hashlib.md5(f"7:{'(null)' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["__probability"] == pytest.approx(p, abs=1e-4) and r["__tokens"] == words(r["text"])
        assert r["__kept"] == (drawn < r["__probability"])


def test_targets_out_of_reach_are_refused(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", "a"), (2, "a b c", "y", "b")], "doc_id long, text string, lang string, source string")
    for local in (10, 0):
        with pytest.raises(ValueError):
            mix(rows, source_targets={"a": 0.5, "b": 0.5}, lang_targets={"x": 0.9, "y": 0.1}, local_cells=local).count()
    with pytest.raises(ValueError):
        rake({("a", "x", "t"): 1.0, ("b", "y", "t"): 1.0}, ({"a": 0.5, "b": 0.5}, {"x": 0.9, "y": 0.1}, None))


def test_raking():
    cells = {("a", "x", "p"): 10.0, ("a", "y", "p"): 30.0, ("b", "x", "p"): 40.0, ("b", "y", "q"): 20.0}
    out = rake(cells, ({"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5}, {"p": 0.8, "q": 0.2}), rounds=500)
    assert sum(v for k, v in out.items() if k[0] == "a") == pytest.approx(50, rel=1e-3)
    assert sum(v for k, v in out.items() if k[2] == "q") == pytest.approx(20, rel=1e-3)


def test_topic_reads_the_whole_text(spark):
    far = "plain words " * 100
    texts = ["LICENSE\n" + far, far + "licensed " + far, far + "license", far]
    rows = mix(spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert got(rows, "doc_id", "__topic") == collections.Counter([(0, "notice"), (1, "notice"), (2, "notice"), (3, "prose")])


def test_every_source_is_raked(spark):
    """300 sources, each with its own share: none is lumped with others, on the driver or as a table."""
    many = spark.range(300).selectExpr("id as doc_id", "repeat('a ', cast(id + 1 as int)) as text", "concat('s', id) as source", "if(id % 2 = 0, 'en', 'de') as lang")
    weights = [{r["source"]: (r["__weight"], r["__probability"]) for r in mix(many, temper=0.5, **k).collect()} for k in ({}, {"local_cells": 0})]
    assert len({round(w, 9) for w, _ in weights[0].values()}) == 300
    for s, found in weights[0].items():
        assert weights[1][s] == pytest.approx(found, rel=1e-6)
    given = {"source_targets": {"s10": 0.5, "s20": 0.25, "(other)": 0.25}, "topic_targets": {"prose": 1.0}}
    local, table = [sorted((r["doc_id"], round(r["__weight"], 6)) for r in mix(many, **given, **k).collect()) for k in ({}, {"local_cells": 0})]
    assert local == table


def test_lm_is_better_than_counts_on_held_out_texts(spark):
    out = lm_score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out")
    score, base = out.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert score > base + 0.2


def test_lm_knows_contexts_of_every_frequent_word(spark):
    """200 word pairs, all of one form: the second word is likely only after its own first word."""
    rng = np.random.default_rng(9)
    text = lambda ks: " ".join(f"aa{k:03d}x bb{k:03d}x" for k in ks)
    right = [(k, text(rng.integers(0, 200, 100).tolist())) for k in range(400)]
    probe = [int(k) for k in rng.integers(0, 200, 100)]
    swapped = " ".join(f"aa{k:03d}x bb{(k + 77) % 200:03d}x" for k in probe)
    rows = spark.createDataFrame([*right, (1000, text(probe)), (1001, swapped)], "doc_id long, text string").repartition(2)
    score = {r["doc_id"]: r["score"] for r in lm_score(rows, held=F.col("doc_id") >= 1000).collect()}
    assert score[1000] > score[1001] + 50


def test_license_scan_of_wrapped_notices(spark):
    """Notices wrapped over lines, with comment signs and text around them."""
    apache = "# some code\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an AS IS BASIS,\n# more"
    permission = "first line\n" * 40 + "Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files (the Software)"
    apart = "All is well.\n" + "some words of no matter " * 9 + "\nrights\n" + "some words of no matter " * 9 + "\nreserved"
    rows = spark.createDataFrame([(0, apache), (1, permission), (2, apart), (3, "All\nrights\n\nreserved")], "doc_id long, text string")
    assert got(license_scan(rows), "doc_id", "labels", "score", "n_blocks") == collections.Counter([(0, "apache", 1.0, 1), (1, "mit", 1.0, 1), (2, "", 0.0, 0), (3, "reserved", 1.0, 1)])
    assert got(similarity_join(rows, ("doc_id",)), "doc_id", "block") == collections.Counter([(0, 1), (1, 40), (3, 0)])


def test_short_templates_are_met_whole(spark):
    rows = spark.createDataFrame([(0, "Released under the Apache License"), (1, "Licensed under CC BY 4.0"), (2, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    assert got(license_scan(rows), "doc_id", "labels") == collections.Counter([(0, "apache"), (1, "cc-by"), (2, "cc-by,cc-by-nc")])
