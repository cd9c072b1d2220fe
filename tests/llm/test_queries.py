"""The registered queries against plain versions, over the whole smallest tables and a fixture of odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import components, licenses, line_dedup, lm, minhash, packing, quality, suffix_dedup, tokens
from cairn.llm import queries as q
from cairn.llm.exprs import lowered, lowered_bytes
from cairn.llm.tables import vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PARA = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall green tree, and nobody minds at all."
LICENSED = "Released under the MIT License.\nThis work is licensed under the GNU General Public License version 3. CC BY, and cc by 4.0!"
ODD = [
    (1, PARA + "\n" + PARA + "\nshort line here, yes."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "word"),
    (6, "one two three"),
    (7, PARA + " And then some more words follow here, different from the first text."),
    (8, PARA + "\n" + PARA + "\nshort line here, yes."),
    (9, LICENSED),
    (10, "x" * 400),
    (11, "naïve façade — “quoted” 北京欢迎你 😀 <|endoftext|>   wide space  two  \n\n tail "),
    (12, " ".join(f"w{i}" for i in range(40_000))),
    (13, "ab " * 500),
    (14, "Home | About | Contact | Login\nAdd to cart\nThis one is a perfectly fine sentence of a good text, it should stay where it is.\n" + PARA),
    (15, "One two three, four five six seven eight nine ten eleven twelve thirteen fourteen."),
    (16, "one two three, four five six seven eight nine ten eleven twelve thirteen fourteen.\nOwn line of this text."),
    (-5, "negative ids come first, " + PARA),
]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(params=["small", "odd", "empty"])
def folder(request, spark, odd_dir, tmp_path):
    if request.param == "small":
        return SF
    if request.param == "odd":
        return odd_dir
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def check_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    parts, places = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert parts.keys() == docs.keys()
    for d, own in parts.items():
        ids = [*tok.encode(docs[d] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            body = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(body)
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(r.length for r in rows), len(places)


def test_encoder_with_a_small_memory():
    """Bytes are split at ASCII white space alone; words met again, forgotten or too long to keep have the same ids."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [[PARA, "a\x1cb c\x85d e\u00a0f\u2028g\x0bh"], ["", "x" * 100, "it's <|endoftext|>end <|startoftext|> " + PARA], [PARA, "x" * 100, " \t\n"], ["new words here", PARA]]
    for most in (1, 1000):
        encode = tokens.Encoder(path, most)
        for some in rows:
            want = [np.array(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
            assert encode([x.encode() for x in some]) == want
        assert ("x" * 100).encode() not in encode.young | encode.old


def test_packing(spark, folder):
    docs = texts(spark, folder)
    tokens, sequences = check_packing(docs, q.op1_packing(spark, folder).collect())
    assert sequences * packing.CAPACITY - tokens < packing.CAPACITY + 0.02 * tokens


def test_suffix_dedup(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op3_suffix_dedup(spark, folder))
    assert found.keys() == docs.keys()
    for d, (runs, kept) in brute.repeats(docs).items():
        want = (len((docs[d] or "").encode()), sum(b - a for a, b in runs), len(runs), brute.sha(kept))
        assert tuple(found[d])[1:5] == want, d


def test_suffix_dedup_of_repeated_rows(spark, tmp_path):
    """Rows of one id and text are one place in whatever tasks they lie; several null ids keep their own texts."""
    body = [" ".join(f"{k}{'abcdefghij'[i % 10]}{i * i}" for i in range(60)) for k in "pqrs"]
    rows = [(1, body[0])] * 6 + [(2, body[0] + " and then an end of its own")] + [(None, body[i]) for i in (1, 2, 3, 1)] + [(None, None), (9, None), (9, "x")]
    for i, row in enumerate(rows):  # a file each, so that each is read by a task of its own
        spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert docs.rdd.getNumPartitions() >= len(rows)
        found = [tuple(r) for r in q.op3_suffix_dedup(spark, str(tmp_path)).collect()]
        left = [tuple(r) for r in suffix_dedup.remaining(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [(d, " and then an end of its own" if d == 2 else t) for d, t in rows]
    facts = [(d, len(t or ""), len(t or "") - len(k or ""), int(t != k), brute.sha(k or "")) for (d, t), (_, k) in zip(rows, kept, strict=True)]
    assert sorted(found, key=repr) == sorted(facts, key=repr)
    assert sorted(left, key=repr) == sorted(kept, key=repr)


@pytest.mark.parametrize("rows", [[(1, "short text"), (2, None)], [(1, ""), (2, "")], [(5, None)] * 3, [(1, "x" * 99), (2, "x" * 99)]])
def test_suffix_dedup_of_short_texts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.n_bytes, r.n_removed) for r in q.op3_suffix_dedup(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((d, len(t or ""), 0) for d, t in rows)


@pytest.mark.parametrize("folder", ["small", "odd"], indirect=True)
def test_suffix_dedup_in_windows(spark, folder, monkeypatch):
    """Groups split into windows give what the sort gives."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 15)
    test_suffix_dedup(spark, folder)


def test_suffix_dedup_of_repeated_windows():
    """Two rows of the same window at the same place are not earlier than each other."""
    columns = {c: pa.array([5, 5], pa.int64()) for c in ("anchor", "doc_id", "s", "e", "a")}
    columns |= {"twin": pa.array([1, 1], pa.int64()), "proof": pa.array([3, 3], pa.int64()), "block": pa.array([0, 0], pa.int32()), "context": pa.array([None, None], pa.binary()), "gone": pa.array([False, False])}
    assert suffix_dedup._sort_bucket(pa.table(columns)).num_rows == 0


def test_minhash(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op4_minhash(spark, folder))
    want = {d: (d, n, c, c == d) for d, (n, c) in brute.near(docs).items()}
    assert {d: (r.doc_id, r.n_shingles, r.component_id, r.kept) for d, r in found.items()} == want


def test_minhash_of_repeated_and_null_ids(spark, tmp_path):
    """Rows of one id are linked by their own texts; rows without an id link with nothing."""
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, PARA), (7, other), (7, other + " end"), (3, PARA), (5, other), (None, PARA), (None, other), (9, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in q.op4_minhash(spark, str(tmp_path)).collect()), key=repr)
    n, m = len(brute.shingles(PARA.split())), 56
    want = [(7, n, 3, False), (7, m, 5, False), (7, m + 1, 5, False), (3, n, 3, True), (5, m, 5, True), (None, n, None, True), (None, m, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert found == sorted(want, key=repr)


def test_embeddings_of_repeated_ids(spark, tmp_path):
    """Every row gives one row with the links of its own vector."""
    a, b, c = ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.05])
    rows = [(2, a, 1), (2, b, 1), (1, c, 1), (2, b, 2), (3, a, 1), (None, a, 1), (4, b, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in q.op7_embedding_dedup(spark, str(tmp_path)).collect()), key=repr)
    want = [(2, 1, 2, True), (2, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True), (3, 1, 2, False), (None, 0, None, True), (4, 2, 1, False)]
    assert found == sorted(want, key=repr)


def test_line_dedup_of_repeated_ids(spark, tmp_path):
    """Rows of one id and text are one place; rows of one id with different texts are documents of their own."""
    own = "This line stands in one text only, and nothing else is like it anywhere."
    rows = [(1, PARA), (1, PARA), (2, own), (2, PARA + "\n" + own + " Or nearly."), (None, "a line that comes first of all, as null ids do."), (3, "a line that comes first of all, as null ids do.\nx"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = q.op9_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_lines) for r in found) == sorted([("1", 1), ("1", 1), ("2", 1), ("2", 2), ("None", 1), ("3", 2), ("4", 0)])
    assert [r.n_removed for r in found if r.doc_id == 1] == [0, 0]
    assert [r.n_removed for r in found if r.doc_id == 3] == [1] and [r.n_removed for r in found if r.doc_id is None] == [0]
    assert sorted(r.n_removed for r in found if r.doc_id == 2) in ([0, 1], [0, 2], [1, 1])


def test_license_scan(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op5_license_scan(spark, folder))
    assert found.keys() == docs.keys()
    for d, r in found.items():
        n, places = brute.licence_places(docs[d])
        starts = [i for i, _ in places]
        labels = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels)), d
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_license_labels_and_scores(spark, tmp_path):
    """Labels and scores equal those of every template tried at every place, on damaged and mixed texts."""
    rng = random.Random(4)
    bodies = [body.split() for body, _ in licenses.TEMPLATES.values()]
    texts = [None, "", "mit license", "All rights reserved."]
    for _ in range(120):
        words = []
        for body in rng.sample(bodies, rng.randrange(1, 4)):
            words += [rng.choice(["of", "the", "software", "x"]) for _ in range(rng.randrange(20))]
            words += [w if rng.random() < 0.85 else rng.choice(["", "changed", "Software"]) for w in body[: rng.randrange(3, len(body) + 1)]]
        texts.append(" ".join(words).title() if rng.random() < 0.3 else ", ".join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(q.op5_license_scan(spark, str(tmp_path)))
    for i, text in enumerate(texts):
        wanted = brute.licences(text, licenses.TEMPLATES, licenses.label_of)
        base = {x for _, x in brute.licence_places(text)[1]}
        assert found[i].labels == ",".join(sorted(base | set(wanted))), text
        assert found[i].score == pytest.approx(max([*wanted.values(), 0.5 if base else 0.0])), text


def test_phrase_places():
    spaced = b" " + b" ".join([b"cc", b"by"] * 50_000) + b" "
    assert licenses.phrase_places(spaced, b"cc by") == list(range(0, 100_000, 2))


def test_license_templates(spark):
    rows = [(i, f"Some words first. {body}. And some after.") for i, (body, _) in enumerate(licenses.TEMPLATES.values())]
    rows.append((len(rows), "a text about nothing in particular"))
    out = {r.doc_id: {m.label for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(licenses.TEMPLATES):
        assert licenses.label_of(name) in out[i], name
    assert out[len(rows) - 1] == set()


def test_license_templates_together(spark):
    """A text that holds several licences keeps the labels of all, however long it grows."""
    bodies = {name: body for name, (body, _) in licenses.TEMPLATES.items()}
    long = "permission is granted to use this software under no conditions of any kind. " * 300
    rows = [(i, f"{bodies['mit']}. {bodies['bsd']}. {long} Here: {body}. And some after.") for i, body in enumerate(bodies.values())]
    rows.append((len(rows), f" {long}\n".join(bodies.values())))
    out = {r.doc_id: {m.label: m.aligned for m in r.matches} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(bodies):
        assert {licenses.label_of(n) for n in ("mit", "bsd", name)} <= {n for n, s in out[i].items() if s == 1.0}, name
    assert out[len(rows) - 1] == dict.fromkeys(map(licenses.label_of, bodies), 1.0)


def test_quality_rules(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op6_quality_rules(spark, folder))
    assert found.keys() == docs.keys()
    for d, r in found.items():
        want = brute.quality(docs[d])
        want.pop("cleaned")
        assert r.asDict() == {"doc_id": d, **want}, d


def test_cleaning_measures_every_text_once(spark):
    """The plan splits texts into words and lines in one place, not in a filter below too."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    plan = quality.clean(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") > 0
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "xxhash64(" in line]


def test_language_model(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op8_language_model(spark, folder))
    want = brute.unigram(docs)
    assert found.keys() == want.keys()
    for d, (held, n, known, total, score) in want.items():
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("folder", ["small", "odd"], indirect=True)
def test_language_model_against_plain_mixing(spark, folder):
    """Scores equal those of the same model applied bit by bit and word by word."""
    docs = texts(spark, folder)
    model = lm.mixing_model(spark.read.parquet(f"{folder}/documents.parquet")).value
    training = [d for d in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for d in training for w in [*brute.words((docs[d] or "").translate(brute.LOWER)), None])
    mass = sum(counts.values()) + len(counts) + 1.0
    found = by_id(q.op8_language_model(spark, folder))
    for d in [d for d in docs if len(docs[d] or "") < 4000][:60]:
        assert found[d].score == pytest.approx(brute.mixed_score(docs[d], model, counts, mass), rel=1e-4, abs=1e-3), d


def test_language_model_fits_weights_to_all_training_texts(spark):
    """The weights of every gate are the best ones for all bits of all training texts, each seen through the tables of the other fold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes, cells, parts, _ = lm.mixing_model(docs).value
    rows = docs.filter(~lm.held_out(F.col("doc_id"))).select("text", lm.fold(F.col("text")).alias("fold")).collect()
    assert len(rows) > 800
    looked_up = []
    counts = np.zeros((2, len(lm.ORDERS), 2 << lm.TABLE_BITS), np.int64)
    for f in (0, 1):
        bodies = [(r.text or "").encode() for r in rows if r.fold == f]
        slots, bit, _ = lm._bits(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]), codes)
        looked_up.append((slots, bit))
        for k, slot in enumerate(slots):
            np.add.at(counts[f, k], 2 * slot.astype(np.int64) + bit, 1)
    every = counts.sum(axis=0)
    odds_of = lambda c: np.clip(np.rint(4 * np.log((c[..., 1::2] + 0.3) / (c[..., ::2] + 0.3))), -31, 31)
    seen_of = lambda c: np.searchsorted([1, 4, 24], c[..., 1::2] + c[..., ::2], "right")
    assert np.array_equal(cells, (odds_of(every) + 32) * 4 + seen_of(every))
    gates, odds, bits = [], [], []
    for f, (slots, bit) in enumerate(looked_up):
        odds.append([odds_of(counts[1 - f, k])[slot] for k, slot in enumerate(slots)])
        seen = [seen_of(counts[1 - f, k])[slot] for k, slot in enumerate(slots)]
        gates.append(seen[0] * 16 + seen[1] * 4 + seen[2])
        bits.append(bit)
    gates, odds, bits = np.concatenate(gates), np.concatenate(odds, axis=1), np.concatenate(bits)
    odds = np.sign(odds) * np.where(odds == 0, 0, np.minimum(2 * ((np.abs(odds) + 1) // 2) - 0.5, 31)) / 4  # two steps count as their middle
    tried = 0
    for g in np.flatnonzero(np.bincount(gates, minlength=64) > 1000):
        own = gates == g
        weights = np.array([parts[k][g * 256 + 36 * 4] for k in range(3)])  # what log odds of 1 come to
        off = 1 / (1 + np.exp(-weights @ odds[:, own])) - bits[own]
        slope = odds[:, own] @ off + 16 * (weights - 0.45)
        assert np.abs(slope).max() < 1e-4 * own.sum(), g
        tried += 1
    assert tried > 10


def test_language_model_against_spelled_unigrams(spark):
    """On held-out texts the score beats the unigram baseline once that has to spell the words it does not know."""
    folder = "/root/testdata/sf0.01"
    docs = texts(spark, folder)
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    known = {w for d in docs if d not in held for w in brute.words((docs[d] or "").translate(brute.LOWER))}
    share = Counter(b for d in docs if d not in held for b in (docs[d] or "").encode())
    total = sum(share.values())
    found = by_id(q.op8_language_model(spark, folder))
    base = sum(found[d].base_score for d in held)
    spelling = sum(math.log10((share[b] + 1) / (total + 256)) for d in held for w in brute.words((docs[d] or "").translate(brute.LOWER)) if w not in known for b in [*w.encode(), 32])
    assert sum(found[d].score for d in held) > base + spelling


def test_language_model_of_repeated_and_null_ids(spark, tmp_path):
    """Every row gets one score, that of its own text, whatever its id."""
    rows = [(1, PARA)] * 3 + [(1, "short")] + [(None, PARA), (None, "word"), (None, None), (2, "word"), (3, PARA), (4, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = q.op8_language_model(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d, _ in rows)
    assert all(r.score < 0 for r in found)
    assert sum(r.bits_per_byte is None for r in found) == 1
    own = {d: round(r.score, 9) for d in (2, 3, 4) for r in found if r.doc_id == d}
    assert sorted(round(r.score, 9) for r in found if r.doc_id == 1) == sorted([own[3]] * 3 + [own[4]])
    assert {own[2], own[3]} <= {round(r.score, 9) for r in found if r.doc_id is None}


def test_language_model_on_held_out_texts(spark):
    """Held-out texts take far fewer bits than under the best model without context, fitted to those very texts."""
    folder = "/root/testdata/sf0.01"
    scored = q.op8_language_model(spark, folder).filter("held_out")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(scored.select("doc_id"), "doc_id")
    body = "".join(r.text or "" for r in docs.select("text").collect()).encode()
    counts = np.bincount(np.frombuffer(body, np.uint8))
    share = counts[counts > 0] / len(body)
    without_context = -(share * np.log2(share)).sum()
    bits = -scored.agg(F.sum("score")).first()[0] / math.log10(2) / len(body)
    assert bits < 0.6 * without_context, (bits, without_context)


def test_line_sketches_bound_and_tell_apart():
    """Sketches never differ in more bits than the sets; long sets with half in common lie further apart than a match may."""
    rng = np.random.default_rng(5)
    for n in (1, 7, 60, 300):
        shared, a, b = (rng.integers(0, 1 << 58, n, dtype=np.uint64) for _ in range(3))
        for keep in (0, n // 2, n - n // 9, n):
            x, y = np.concatenate([shared[:keep], a[keep:]]), np.concatenate([shared[:keep], b[keep:]])
            found = line_dedup.sketches(np.concatenate([x, y]), np.array([n, n])).to_pylist()
            bits = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(found[0].values(), found[1].values(), strict=True))
            assert bits <= 2 * (n - keep)
            if n >= 60 and keep == n // 2:
                assert bits * 180 > 2 * n * 20
    assert len(line_dedup.sketches(np.empty(0, np.uint64), np.empty(0, np.int64))) == 0


def test_line_dedup(spark, folder):
    docs = texts(spark, folder)
    found = by_id(q.op9_line_dedup(spark, folder))
    assert found.keys() == docs.keys()
    for d, kept in brute.line_dedup(docs).items():
        assert (found[d].kept_chars, found[d].kept_sha256) == (len(kept or ""), brute.sha(kept or "")), d


def test_line_dedup_runs_no_python(spark, tmp_path, monkeypatch):
    """All steps are built-in functions, and the sketch equals the plain one; fails with tasks in Python."""
    plans = []
    kept = line_dedup.settled_parquet
    monkeypatch.setattr(line_dedup, "settled_parquet", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    rows = [(i, f"{PARA} {i % 3}\n{PARA[i:]}\nshort {i % 2}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = q.op9_line_dedup(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(word in plan for plan in plans for word in ("InArrow", "InPandas", "EvalPython"))
    tokens = np.random.default_rng(5).integers(-(2**63), 2**63, 70)
    found = spark.createDataFrame([(tokens.tolist(),)], "tokens array<long>").select(line_dedup._sketch("tokens").alias("s")).first().s
    assert found.asDict() == line_dedup.sketches(tokens.view(np.uint64), np.array([70])).to_pylist()[0]


def test_line_dedup_of_large_crowds(spark, tmp_path, monkeypatch):
    """Lines of large crowds that no leader matches meet by their rarest tokens, and none is missed."""
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(120):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{rng.integers(0, 6)}"
        docs[i] = " ".join(words[int(rng.integers(0, 8)) :])
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = by_id(q.op9_line_dedup(spark, str(tmp_path)))
    want = brute.line_dedup(docs)
    assert {d: found[d].kept_sha256 for d in docs} == {d: brute.sha(t or "") for d, t in want.items()}
    assert 2 < sum(1 for t in want.values() if t) < 118


def test_bpe(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    docs = texts(spark, folder)
    found = by_id(q.op10_bpe(spark, folder))
    assert found.keys() == docs.keys()
    for d, text in docs.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False)))
        assert tuple(found[d])[1:4] == want, d


def test_embeddings(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in q.op7_embedding_dedup(spark, SF).collect()}
    assert found == brute.similar_vectors(rows)


def test_embeddings_odd_rows(spark, tmp_path):
    base = [float(i % 7) - 3 for i in range(16)]
    near = [x + 0.01 for x in base]
    rows = [(1, base, 1), (2, base, 1), (3, near, 1), (4, base, 2), (5, base, None), (6, None, 1), (7, [], 1), (8, [0.0] * 16, 1)]
    rows += [(9, [float("nan"), *base[1:]], 1), (10, [None, *base[1:]], 1), (11, [float("inf"), *base[1:]], 1), (12, base[:8], 1), (0, [-x for x in base], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    found = {r.vec_id: (r.n_links, r.component_id) for r in q.op7_embedding_dedup(spark, f"{tmp_path}/a").collect()}
    assert found == brute.similar_vectors([(i, label, v) for i, v, label in rows])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert q.op7_embedding_dedup(spark, f"{tmp_path}/b").collect() == []


def test_embeddings_of_a_dense_group(spark, tmp_path):
    """Every pair of thousands of distinct near copies is a link, and pairs in sparser and mixed company are found too."""
    rng = np.random.default_rng(5)
    hub = rng.standard_normal(16)
    vectors = np.concatenate([hub + 0.002 * rng.standard_normal((3000, 16)), hub + 0.35 * rng.standard_normal((1500, 16)), rng.standard_normal((500, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(5000, vectors[0].tolist(), 1), (5001, vectors[0].tolist(), 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = np.concatenate([vectors, vectors[:1]]).astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.93
    low = np.arange(len(near))
    while (less := np.where(near, low, len(low)).min(axis=1)).tolist() != low.tolist():
        low = less
    want = {i: (int(near[i].sum()) - 1, int(low[i])) for i in range(len(near))} | {5001: (0, 5001)}
    found = q.op7_embedding_dedup(spark, str(tmp_path)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def check_chat(rows, found):
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, role or "", text or ""))
    assert found.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), brute.sha(said), len(loss), brute.sha(loss)), c


PROBE = [(-7, 0, "user", q.PROBE), (-7, 1, "assistant", q.PROBE)]


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_chat(rows + PROBE, {r.conv_id: r for r in q.op2_chat_format(spark, SF).collect()})


def test_chat_odd_rows(spark, tmp_path):
    marks = ["</turn>\n", "<turn user>\n", "\\", "\\\\", ">\n", "### User:", "<\\turn ", "a\n>\nb", "</turn>", "", None, "### System:\n\\### "]
    rows = [(i, j, "assistant" if j % 2 else "user", marks[(i + j) % len(marks)]) for i in range(12) for j in range(4)]
    rows += [(20, 0, "tool</turn>\n", "x"), (20, 1, None, "y"), (20, 1, None, "y"), (21, 0, "assistant", "first"), (22, 0, "user", "z" * 300_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in q.op2_chat_format(spark, str(tmp_path)).collect()}
    check_chat(rows + PROBE, found)
    assert found[-7].valid and not found[20].valid and not found[21].valid


def pipeline_texts(docs):
    kept = {}
    for d, text in docs.items():
        found = brute.quality(text)
        if found["kept"]:
            kept[d] = found["cleaned"]
    kept = brute.line_dedup(kept)
    comp = brute.near(kept)
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    return {d: left.decode("utf-8", "ignore") for d, (_, left) in brute.repeats(kept).items()}


def test_pipeline(spark, folder):
    want = pipeline_texts(texts(spark, folder))
    check_packing(want, corpus_pipeline.run(spark, folder).collect())


def test_pipeline_stages_keep_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name in ("n_lines", "n_removed", "n_chars", "k", "rep", "kept", "quality", "block", "line", "n", "__of", "component_id"):
        docs = docs.withColumn(name, F.lit(1).cast("long"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == columns
        out.collect()



def test_packed_numbers():
    for numbers in ([], [0, 7], [1, 1 << 32, 5]):
        assert tokens.unpack_numbers(tokens.pack_numbers(np.array(numbers, np.int64))).tolist() == numbers


def test_line_dedup_compares_by_sketches_and_meets_once(spark, tmp_path, monkeypatch):
    """Sketches by rows equal the plain ones, keep most pairs with leaders from the full sets, and a pair comes of one token however many it shares."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{w}" for w in range(60)) + " " + " ".join(f"x{rng.integers(1 << 30)}" for _ in range(12))) for i in range(30)]
    rows += [(i + 30, f"É{i} Ω Ä ä {'A' * i} ã© end") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._lines(line_dedup._placed(docs))
    sets = line_dedup._sets(lines)
    both = line_dedup._sketched(sets).join(sets.select(F.struct(*line_dedup.PLACE).alias("x"), line_dedup._sketch("tokens").alias("plain")), "x").collect()
    assert len(both) == 39 and all(r.sketch == r.plain for r in both)
    met, verified = [], []
    meet, verify = line_dedup._met, line_dedup._verified
    monkeypatch.setattr(line_dedup, "_met", lambda *a: met.append(meet(*a)) or met[-1])
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, sets: verified.append(pairs.count()) or verify(pairs, sets))
    found = line_dedup.removed_lines(docs).select("doc_id").distinct().collect()
    want = {d for d, t in brute.line_dedup(dict(rows)).items() if t == ""}
    assert {r.doc_id for r in found} == want
    assert verified[0] < 30  # before: every line of a crowd with its head
    for pairs in met:
        assert pairs.count() == pairs.distinct().count()


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions the shuffles have, tables made on the way are written by few tasks; before, each by as many as there were partitions."""
    docs = spark.createDataFrame([(i, f"{PARA} {i % 90}\n{PARA[i % 50:]} {i}\n" + " ".join(f"w{i % 40}x{k}" for k in range(60))) for i in range(400)], "doc_id long, text string")
    made = []
    parquet, checked = line_dedup.settled_parquet, minhash.settled
    monkeypatch.setattr(line_dedup, "settled_parquet", lambda df: made.append(parquet(df)) or made[-1])
    for module in (minhash, components):
        monkeypatch.setattr(module, "settled", lambda df: made.append(checked(df)) or made[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 211)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gone = {(r.doc_id, r.line) for r in line_dedup.removed_lines(docs).collect()}
        tables = len(made)
        near = minhash.near_duplicates(docs).filter("kept").count()
        few = max(2 * spark.sparkContext.defaultParallelism, 211 // 16)
        assert all(len(df.inputFiles()) <= few for df in made[:tables])
        assert all(df.rdd.getNumPartitions() <= few for df in made[tables:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tables > 5 and len(made) > tables
    assert gone == {(r.doc_id, r.line) for r in line_dedup.removed_lines(docs).collect()}
    assert near == minhash.near_duplicates(docs).filter("kept").count()


def test_language_model_looks_up_by_parts():
    """Slots equal a plain walk over each text alone, word counts come by their hash, and bits are counted slice by slice; before, they were gathered and copied first."""
    rng = np.random.default_rng(4)
    bodies = [b"", b"a", b" \n", b"ab c", b"x" * 9, "É ü".encode(), b"", *(bytes(rng.integers(30, 127, n).astype(np.uint8)) for n in (3, 7, 8, 200))]
    flat = lambda texts: (np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    codes = lm.Codes(np.ones((lm.SYMBOLS, lm.SYMBOLS), np.int64))
    slots, bit, ends = lm._bits(*flat(bodies), codes)
    at = 0
    for body in bodies:
        for i, symbol in enumerate([*body, lm.END]):
            key = (body[i - 1] if i else lm.END) * lm.SYMBOLS + symbol
            since = next((d for d in range(1, i + 1) if body[i - d] in b" \t\n\x0b\x0c\r"), lm.WORD)
            here = np.arange(codes.start[key], codes.start[key] + codes.length[key])
            for k, found in zip(lm.ORDERS, slots, strict=True):
                reach = min(max(1, min(since, lm.WORD)) if k == lm.WORD else k, i)
                known = int.from_bytes(body[i - reach : i], "little") + (reach << 56) + (k << 60)
                context = lm.tb.mix(np.array([known % 2**64], np.uint64)) >> np.uint64(32)
                assert (found[ends[at] : ends[at + 1]] == (context.astype(np.uint32) + codes.node[here]) >> np.uint32(32 - lm.TABLE_BITS)).all()
            assert (bit[ends[at] : ends[at + 1]] == codes.bit[here]).all()
            at += 1
    words = np.unique(np.append(rng.integers(0, 2**64, 3000, np.uint64), [np.uint64(0), ~np.uint64(0)]))
    mixed = rng.permutation(len(words))
    assert (lm.Counts(words[mixed], mixed).of(words) == np.arange(len(words))).all()
    assert lm.Counts(words[:1], np.array([5])).of(words[:1]).tolist() == [5]
    texts = [bytes([97 + i]) * (lm.SLICE // 2) for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in texts]), pa.array(np.zeros(8, np.int32))], ["text", "fold"])
    parts = list(lm._fold_bits(iter([batch]), codes))
    assert len(parts) == 4 and all(f == 0 for f, _, _ in parts)


def test_lowered_bytes_tell_apart_what_lowered_does(spark):
    letters = ["A", "a", "Z", "z", "É", "é", "Ä", "ã", "İ", "i", "ſ", "K", "Σ", "ς", "Д", "д", "中", "丽", "😀", "\U00010400", "\U00010428", " ", "\u0085", "1"]
    rows = [(x + y,) for x in letters for y in letters] + [(x,) for x in letters]
    found = spark.createDataFrame(rows, "t string").select(lowered("t").alias("l"), lowered_bytes(F.col("t")).alias("b")).distinct().collect()
    assert len({r.l for r in found}) == len({r.b for r in found}) == len(found)
    assert len(found) < len(rows)
