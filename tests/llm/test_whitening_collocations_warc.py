"""Whitening against numpy's eigenvectors, collocations against plain counting, archives against what was written."""

import base64
import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from cairn.llm import collocations, queries, warc, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening


def _plain_whitening(vectors, k=16):
    x = np.array([np.floor(64 * np.array(v, np.float64)) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, at = np.linalg.eigh(centred.T @ centred / len(fit))
    values, at = values[::-1][:k], at[:, ::-1][:, :k]
    return (x - fit.mean(axis=0)) @ at / np.sqrt(values), values / np.trace(centred.T @ centred / len(fit)), len(fit), x, fit


def test_whitening_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    white, explained, n, x, fit = _plain_whitening(rows.embedding)
    found = queries.op11_whitening(spark, SF).toPandas()
    assert len(found) == len(rows) * 16 and set(found.n) == {n}
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    own = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    sign = np.sign((own * white).sum(axis=0))
    assert np.abs(own * sign - white).max() < 1e-8
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-9)
    sums = [int(v) for v in fit.sum(axis=0)]
    exact = {i: sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in zip(rows.vec_id, x, strict=True)}
    assert {(r.vec_id, r.deviation) for r in found.itertuples()} == set(exact.items())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    plain = [[float(c) for c in v] for v in rng.normal(size=(40, 3))]
    odd = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [], [1e300, 0.0, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(plain + odd)] + [(0, plain[0], "y"), (100, plain[1], "y"), (None, plain[2], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").selectExpr("*", "1 AS component", "2 AS x")
    found = whitening.whiten(table).toPandas()
    white, explained, n, _, _ = _plain_whitening(plain)
    assert n == 40 and set(found.n) == {40} and len(found) == 43 * 3
    assert sorted(found.vec_id.dropna().unique()) == [*range(40), 100]
    assert (found.vec_id == 0).sum() == 6
    own = found[(found.vec_id > 0) & (found.vec_id < 40)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(own) - np.abs(white[1:])).max() < 1e-9
    assert whitening.whiten(table.filter("vec_id < 0")).count() == 0
    assert whitening.whiten(table.filter("vec_id = 0")).count() == 0  # one distinct vector has no direction
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


@pytest.mark.parametrize("shape", ["falling", "clustered", "low rank"])
def test_iteration_restarts_and_locks(shape):
    rng = np.random.default_rng(3)
    d = 300
    values = {"falling": np.geomspace(1e3, 1e-3, d), "clustered": np.repeat([50.0, 49.999999, 3.0], 100), "low rank": np.append(np.arange(20.0, 0, -1), np.zeros(d - 20))}[shape]
    at = np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix = (at * values) @ at.T
    calls = []
    found, vectors = whitening.jacobi_davidson(lambda b: calls.append(b.shape) or matrix @ b, d, 16)
    assert np.allclose(found, np.sort(values)[::-1][:16], rtol=1e-11)
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-11 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert max(s[1] for s in calls) <= 64  # never the whole matrix


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 30))
    m = m + m.T
    right = rng.normal(size=(30, 3))
    assert np.abs(m @ whitening.minres(lambda b: m @ b, right, 60) - right).max() < 1e-6


# ---------------------------------------------------------------- collocations


def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, piece, word = [], [], ""
    for c in low + "\n":
        if c in " \t" or c in ".,;:!?\n\x0b\x0c\r":
            piece += [word] if word else []
            word = ""
            if c not in " \t":
                out, piece = out + [piece], []
        else:
            word += c
    return out


def _plain_mining(docs, least, most):
    times, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for p in _pieces(text):
            n[lang] += len(p)
            for k in range(1, 5):
                times.update((lang, tuple(p[i : i + k])) for i in range(len(p) - k + 1))
    out, often = {}, {key: a for key, a in times.items() if a >= least}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        longer = max((b for (g, q), b in often.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
        if 100 * longer >= 80 * a:
            continue
        score, k = min((int(Fraction(2_000_000 * a, times[lang, p[:k]] + times[lang, p[k:]])), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((" ".join(p), a, times[lang, p[:k]], times[lang, p[k:]], n[lang], score))
    return {(lang, i + 1, *row) for lang, rows in out.items() for i, row in enumerate(sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:most])}


def _mined(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_collocations_against_plain_counting(spark):
    rng = random.Random(7)
    words = ["a", "B", "cc", "d", "éa", "ÉA", "w" * 300, "x-y", "\x00"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", " ! ", ",", "\x0b"]
    docs = [(rng.choice(["en", None, "de"]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 3, 40, 400])))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("en", " .. "), ("fr", "z " * 500), ("fr", "z")] + [docs[3]] * 40
    table = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS chunk", "2 AS phrase")
    for least, most in ((3, 25), (30, 2000)):
        assert _mined(collocations.mine(table, least, most)) == _plain_mining(docs, least, most)
    assert collocations.mine(table.limit(0)).count() == 0


def test_every_occurrence_lies_in_one_chunk(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()] * 2
    chunks = collocations.parse(spark.createDataFrame(docs, "lang string, text string")).collect()
    assert sum(c.times for c in chunks) > len(chunks) > len(docs)
    assert sum(c.times * c.words for c in chunks) == sum(len(p) for _, t in docs for p in _pieces(t))
    assert all(sum(map(len, _pieces(c.chunk.decode()))) == c.words + (0 if c.tail else collocations.OVERLAP) for c in chunks)


def test_a_full_table_of_bits_loses_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    wanted = _mined(collocations.mine(docs, 10))
    monkeypatch.setattr(collocations, "TABLE", 1 << 17)
    monkeypatch.setattr(collocations, "GATHERED", 1000)
    assert _mined(collocations.mine(docs, 10)) == wanted


# ---------------------------------------------------------------- archives

TRICKY = [None, "", "plain", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb", "\r\n\r\n", "é\x00 ", "plain", "plain", "x" * 300_000, ""]


def _pages(spark, copies=1):
    urls = ["http://www.A.org:80/x?y#z", None, "https://u:p@b.a.org:8080", " http://c.org/é\r\nX-Bad: 1 ", "ftp://c.org?q"]
    rows = [(i if i != 4 else None, urls[i % len(urls)], TRICKY[i]) for i in range(len(TRICKY))] * copies
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS id", "'q' AS value")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_give_back_what_was_written(spark, compression):
    path = warc.write(_pages(spark), compression=compression)
    found = {r.id: r for r in warc.read_payloads(spark, path).collect()}
    assert len(found) == len(TRICKY)
    kept = {i if i != 4 else None: p or "" for i, p in enumerate(TRICKY)}
    for i, r in found.items():
        assert (r.record_type == "response") == (i not in (0, 1, 2, 6))
        assert r.payload == (kept[i] if r.record_type == "response" else None)
    index = {r.id: r for r in warc.index(spark, path).collect()}
    for i, text in kept.items():
        assert index[i].payload_bytes == len(text.encode())
        assert index[i].payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert {i: index[i].refers_to for i in (0, 1, 2, 6)} == {0: 9, 1: 9, 2: 7, 6: 7}
    assert [index[i].url_key for i in (0, 1, 2, 3, None)] == ["org,a)/x?y", "", "org,a,b:8080)/", "org,c)/é%0D%0AX-Bad: 1", "org,c)/?q"]


def test_small_payloads_are_always_stored(spark):
    path = warc.write(_pages(spark), least=6)
    assert {r.record_type for r in warc.index(spark, path).collect()} == {"response"}


def test_index_is_in_order_over_all_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 60)
    rng = random.Random(2)
    rows = [(i, "http://hot.org/" if rng.random() < 0.4 else f"http://h{rng.randrange(60)}.org/{rng.randrange(3)}", f"t{rng.randrange(50)}") for i in range(900)]
    rows += rows[:50]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))
    found = sorted(warc.index(spark, path).collect(), key=lambda r: r.history_rank)
    assert len({r.file for r in found}) >= 14
    assert [r.history_rank for r in found] == list(range(1, len(rows) + 1))
    assert [(r.url_key, r.at, r.id) for r in found] == sorted((r.url_key, r.at, r.id) for r in found)
    assert [r.id for r in found] == [i for _, i in sorted((warc.url_key(u), i) for i, u, _ in rows)]
    seen = Counter()
    for r in found:
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]
    last = {}
    for i, _, html in rows:
        last[html] = max(i, last.get(html, i))
    wanted = {i: None if last[h] == i else last[h] for i, _, h in rows}
    assert {r.id: r.refers_to for r in found} == wanted


def test_empty_and_damaged_archives(spark, tmp_path):
    assert warc.index(spark, warc.write(_pages(spark).limit(0))).count() == 0
    path = warc.write(_pages(spark), compression="none")
    data = b"".join(r.content for r in warc.archives(spark, path).collect())
    assert len(list(warc.parsed(memoryview(data)))) == len(TRICKY)
    for bad in (data.replace(b"xxxx", b"xxxy"), data[: len(data) // 2], b"junk\r\n" + data):
        with pytest.raises(ValueError):
            list(warc.parsed(memoryview(bad)))


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        lists = [sorted((f"k{rng.randrange(5)}", "t", rng.randrange(9), f"f{f}", i) for i in range(rng.randrange(7))) for f in range(k)]
        lists = [sorted(x, key=warc._sort_key) for x in lists]
        assert list(warc.LoserTree(lists)) == sorted((e for x in lists for e in x), key=warc._sort_key)
