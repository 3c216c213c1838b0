"""Phrase mining, ranked search and the language model against brute force, with edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import ORACLES, QUERIES, elias_fano, language_model, lexical_search, phrase_mining

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 70} É{i % 50}," * (i % 3) + "the new york times" for i in range(4000))
ROWS = [
    (1, "The new York Times. the New york\ttimes", "en"), (2, None, "en"), (3, "", None), (4, "  \t\n.,", "en"), (5, LONG, None), (6, LONG, "en"), (7, LONG[7:20000], "en"),
    (5, LONG, None), (8, "a", ""), (9, "of the  people; by the people: for the people!" * 5, "fr"), (9, "other text of the same id", "fr"), (None, "the new york times", "en"),
    (None, None, None), (10, "日本語 テキスト です 日本語 テキスト", "ja"), *[(20 + i, f"the new york times wrote x{i} of the people {i % 4}", "en") for i in range(60)],
    *[(100 + i, "copy of the same text in the new york times", "de") for i in range(40)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, g, "x", 7) for d, t, g in ROWS], "doc_id long, text string, lang string, h string, n int").repartition(3).cache()


def mined(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang if lang is not None else "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        hidden = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        rows_ = []
        for p, a in cand.items():
            if p not in hidden:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,sample", [(3, 5, 2000, 0.3), (20, 5, 7, 0.0), (2, 3, 50, 1.0), (5, 2, 50, 0.5)])
def test_phrases_match_brute_force(docs, least, longest, top, sample):
    got = phrase_mining.collocations(docs, min_count=least, longest=longest, top=top, sample=sample)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(ROWS, least, longest, top)


def test_phrases_do_not_depend_on_the_bit_table(docs, monkeypatch):
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(phrase_mining.bits_of, "__defaults__", (1 << 16,))
    monkeypatch.setattr(phrase_mining, "SLICE", 500)
    assert sorted(tuple(r) for r in phrase_mining.collocations(docs, min_count=3, sample=0.0).collect()) == mined(ROWS, 3, 5, 2000)


@pytest.mark.parametrize("ahead,sample,most", [(9.0, 0.0, 2), (9.0, 0.2, 2), (0.0, 0.2, 5)])
def test_phrases_missed_by_the_sample_take_one_more_pass(docs, monkeypatch, ahead, sample, most):
    names, write = [], phrase_mining.materialize
    monkeypatch.setattr(phrase_mining, "AHEAD", ahead, raising=False)
    monkeypatch.setattr(phrase_mining, "SLICE", 5000)
    monkeypatch.setattr(phrase_mining, "materialize", lambda df, name: names.append(name) or write(df, name))
    got = phrase_mining.collocations(docs, min_count=3, sample=sample)
    assert sorted(tuple(r) for r in got.collect()) == mined(ROWS, 3, 5, 2000)
    assert 2 <= names.count("frequent") <= most


def test_phrases_of_nothing(docs):
    assert phrase_mining.collocations(docs.where("false")).collect() == []
    assert phrase_mining.collocations(docs.where("text IS NULL")).collect() == []
    assert phrase_mining.collocations(docs.select(F.col("text").alias("BODY"), F.col("lang").alias("L")), "body", "l", min_count=20, top=7).count() == len(mined(ROWS, 20, 5, 7))


def test_phrases_score_is_exact_beyond_64_bits(spark):
    row = spark.sql("SELECT CAST((CAST(4000000000000 * 1000 AS decimal(38,0)) * CAST(9000000000000007 AS decimal(19,0))) AS decimal(38,0)) div "
                    "(CAST(5000000000000 AS decimal(19,0)) * CAST(7000000000001 AS decimal(19,0))) AS s").first()
    assert row.s == 4000000000000 * 1000 * 9000000000000007 // (5000000000000 * 7000000000001)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [("a", "the New york"), ("b", "people zzz"), ("c", None), ("d", "... !"), ("a", "copy the"), (None, "times é1 日本語"), ("e", LONG), ("e", LONG)]


def terms(text):
    return WORD.findall((text or "").translate(FOLD))


def ranked(rows, items, top):
    bags = [(d, Counter(terms(t))) for d, t, _ in rows]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    queries = defaultdict(set)
    for item, text in items:
        queries[item] |= set(terms(text))
    out = []
    for item, q in queries.items():
        found = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // max(total, 1)
            s = sum(weight[t] * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in q if t in b)
            if s > 0:
                found.append((-s, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top,block", [(50, 1 << 20), (3, 1 << 20), (1000, 20)])
def test_search_matches_brute_force(spark, docs, top, block):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = lexical_search.search(docs, items, top=top, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(ROWS, ITEMS, top)


def test_search_in_small_pieces(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 64)
    items = spark.createDataFrame(ITEMS, "ITEM_ID string, text string")
    assert sorted((tuple(r) for r in lexical_search.search(docs, items, top=5).collect()), key=repr) == ranked(ROWS, ITEMS, 5)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical_search.search(docs.where("false"), items).collect() == []
    assert lexical_search.search(docs, items.where("false")).collect() == []
    assert lexical_search.search(docs, items.where("item_id = 'd'")).collect() == []


@pytest.mark.parametrize("name", ["op11_toivonen_collocations", "op12_bag_class_search"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, sf).select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("values", [[], [0], [5], [2**64 - 1], [0, 2**64 - 1], list(range(9000)), [7, 7, 7, 8], [i * i * 1000003 for i in range(20000)]])
def test_sequences_round_trip(values):
    v = np.array(values, np.uint64)
    s = elias_fano.Sequence(elias_fano.mapped(elias_fano.to_payload(elias_fano.encode("s", v))), "s")
    assert s.get(np.arange(len(v))).tolist() == values
    asked = np.array(sorted({x + d for x in values[::97] for d in (-1, 0, 1) if 0 <= x + d < 2**64} | {0, 3}), np.uint64)
    at, equal = s.find(asked)
    assert equal.tolist() == [int(x) in set(values) for x in asked]
    assert at[equal].tolist() == np.searchsorted(v, asked)[equal].tolist()


def test_sequences_are_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 200, 100_000)).astype(np.uint64)
    assert len(elias_fano.to_payload(elias_fano.encode("s", v))) < 100_000 * 1.3  # 8 bytes each as plain numbers


def spaced(text):
    return [w.translate(FOLD) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def model_scores(rows, least, discount, quantise=True):
    q = (lambda p: float(language_model.restored(language_model.quantised(np.array([p])))[0])) if quantise else (lambda p: p)
    one, two, three, ctx1, ctx2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2:
            s = ["<s>", "<s>", *spaced(t)]
            for u, v, w in zip(s, s[1:], s[2:]):
                one[w] += 1; two[v, w] += 1; three[u, v, w] += 1; ctx1[v] += 1; ctx2[u, v] += 1
    total, words = sum(one.values()), len(one)
    two, three = ({k: n for k, n in c.items() if n >= m} for c, m in ((two, least[0]), (three, least[1])))
    d2, d3 = {k: (n - discount) / ctx1[k[0]] for k, n in two.items()}, {k: (n - discount) / ctx2[k[:2]] for k, n in three.items()}
    left1, left2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for k, p in d2.items():
        left1[k[0]] -= p
    for k, p in d3.items():
        left2[k[:2]] -= p

    def prob(u, v, w):
        lower = (q(d2[v, w]) if (v, w) in d2 else 0.0) + q(left1[v]) * (one[w] + 1) / (total + words + 1)
        return (q(d3[u, v, w]) if (u, v, w) in d3 else 0.0) + q(left2[u, v]) * lower

    out = []
    for d, t, _ in rows:
        s = ["<s>", "<s>", *spaced(t)]
        out.append((d, len(s) - 2, sum(one[w] > 0 for w in s[2:]), sum(math.log10((one[w] + 1) / (total + words + 1)) for w in s[2:]),
                    sum(math.log10(prob(*x)) for x in zip(s, s[1:], s[2:]))))
    return out, total, (one, prob)


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 2))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9, atol=1e-4)  # sums travel in fixed point


@pytest.mark.parametrize("least,short,cell_tokens", [((1, 2), 1 << 20, 1 << 20), ((1, 1), 10, 1000), ((2, 2), 0, 200), ((1, 2), 3, 60)])
def test_lm_matches_brute_force(docs, least, short, cell_tokens):
    """Also with few short codes (rare words resolved by a join) and small cells (counted in parts, tries in copies)."""
    want, total, _ = model_scores(ROWS, least, language_model.DISCOUNT)
    model = language_model.fit_ngrams(docs.where(~language_model.held_out()), least=least, short_codes=short, cell_tokens=cell_tokens)
    assert model.tokens == total
    assert short == 1 << 20 or len(model.codes.value[3]) <= short
    if cell_tokens < 1000:
        assert (model.loads > 2 * cell_tokens).any()
    got = language_model.score_ngrams(docs, model, cell_tokens=cell_tokens).select("doc_id", "n_tokens", "n_known", "base_score", "score")
    same([tuple(r) for r in got.collect()], want)
    both = language_model.train_and_score(docs, ~language_model.held_out(), least=least, short_codes=short, cell_tokens=cell_tokens)
    same([tuple(r) for r in both.select(got.columns).collect()], want)
    assert {r.train_tokens for r in both.select("train_tokens").collect()} == {total}


def test_lm_is_a_distribution():
    _, _, (one, prob) = model_scores(ROWS, (1, 2), language_model.DISCOUNT, quantise=False)
    for u, v in (("the", "new"), ("of", "the"), ("<s>", "<s>"), ("never", "seen")):
        assert abs(sum(prob(u, v, w) for w in one) + prob(u, v, "unseen word") - 1) < 1e-9


def test_lm_of_nothing(docs):
    model = language_model.fit_ngrams(docs.where("false"))
    rows = language_model.score_ngrams(docs.where("doc_id IN (3, 8)"), model).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows) == [(3, 1, 0, 0.0, 0.0), (8, 2, 0, 0.0, 0.0)]
    full = language_model.fit_ngrams(docs.withColumnRenamed("text", "BODY"), "body")
    assert language_model.score_ngrams(docs.where("false"), full).collect() == []
    with pytest.raises(ValueError):
        language_model.fit_ngrams(docs, least=(3, 2))


def test_lm_on_table(spark, sf):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, total, _ = model_scores(rows, language_model.LEAST, language_model.DISCOUNT)
    out = QUERIES["op13_elias_fano_scores"](spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double",
                                "score": "double"}
    got = out.collect()
    assert {r.train_tokens for r in got} == {total}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    same([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], want)
    kept = [r for r in got if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)  # better than word counts on texts it has not seen


@pytest.mark.parametrize("high", [(5, 7, 9), (3, 1 << 20, 1 << 20), (1 << 30, 1 << 30, 1 << 30)])
def test_lm_order_of_ngrams(high):
    """As one number, or by the keys one after another where that has more than 64 bits."""
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, h, 3000).astype(np.int32) for h in high]
    order, want = language_model._order(*keys), np.lexsort(keys[::-1])
    assert all((k[order] == k[want]).all() for k in keys)
    assert sorted(order.tolist()) == list(range(3000))
    assert len(language_model._order(*[k[:0] for k in keys])) == 0


def test_lm_asks_once_per_distinct_ngram():
    """The n-grams of all blocks of a cell come together; each distinct one is asked for once."""
    rng = np.random.default_rng(5)
    words = np.array([3, 9, 2**40, 2**64 - 1], np.uint64)
    blocks = [[*(words[rng.integers(0, 4, n)] for _ in range(3)), rng.integers(0, 2, n).astype(np.uint32)] for n in (40, 1, 300)]
    found = language_model.Occurrences([language_model._pack(*b) for b in blocks], [[np.arange(2)]] * 3)
    want = [(int(v), int(u), int(w), int(t) + 2 * i) for i, b in enumerate(blocks) for v, u, w, t in zip(*b)]
    code = lambda x: found.codes[x[found.ngram]].tolist()
    assert list(zip(code(found.v), code(found.u), code(found.w), found.owner.tolist())) == want
    assert list(zip(found.v.tolist(), found.u.tolist(), found.w.tolist())) == sorted({tuple(np.searchsorted(found.codes, np.array(x[:3], np.uint64)).tolist()) for x in want})
    train = np.array([1, 0, 1, 1, 0, 1], np.uint8)
    seen = Counter(x[:3] for x in want if train[x[3]])
    kept = language_model.Trie(found.trie(train, (1, 2), 0.75), found.codes)
    assert len(kept.value["d3"]) == sum(n > 1 for n in seen.values())
    assert len(kept.value["d2"]) == len({(v, w) for v, _, w in seen})
    assert found.trie(np.zeros(6, np.uint8), (1, 2), 0.75) is None


def test_lm_does_not_read_texts_again(spark, sf):
    """Tokens and base of a text are found where its n-grams are cut, not in a further pass."""
    assert not [f for f in QUERIES["op13_elias_fano_scores"](spark, sf).inputFiles() if "documents" in f]
