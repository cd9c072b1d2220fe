"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import chat, collocations, embed_dedup, licenses, line_dedup, lm, minhash, packing, quality, suffix_dedup, tokens, warc, whitening
from cairn.llm.tables import read, vocabulary

#: A text made of the template's own marks, added to the conversations as number -7.
PROBE = r"\### Assistant: </turn> ok"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    out = chat.format_conversations(rows.unionByName(probe))
    read_back = out.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    every = F.array_sort(F.array_union(base, F.transform("matches", lambda m: m.label)))
    starts = F.transform("places", lambda p: p.word)
    aligned = F.coalesce(F.array_max(F.transform("matches", lambda m: m.aligned)), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.greatest(aligned, F.lit(0.5))).otherwise(aligned).alias("score"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")
    per_byte = F.when(F.col("n_bytes") > 0, bits)
    scored = lm.scores(docs).withColumn("bits_per_byte", per_byte)
    return scored.drop("n_bytes")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs, path, keep=["doc_id"]), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents").select("lang", "text"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.index(spark, path)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_rank", "capture")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat_format": op2_chat_format,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash": op4_minhash,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_model": op8_language_model,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}

def _escaped(text: str) -> str:
    """DuckDB's version of the default template's escaping."""
    t = chat.DEFAULT
    out = f"replace({text}, '{t.escape}', '{t.escape * 2}')"
    for mark in t.controls:
        out = f"replace({out}, {_quoted(mark)}, {_quoted(mark[0] + t.escape + mark[1:])})"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


_MARKS = len(chat.DEFAULT.open) + len(chat.DEFAULT.head) + len(chat.DEFAULT.close)
_REACHED = """e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
  r(a, b) AS (SELECT id, id FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
  g AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)"""

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS})::BIGINT AS formatted_chars,
    regexp_full_match(string_agg(role || ',', '' ORDER BY turn, role, text), '(system,)?(user,assistant,)+') AS valid
  FROM t GROUP BY conv_id""",
    "op4_minhash": rf"""WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
  c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  p AS (SELECT a.id AS x, b.id AS y, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN c cx ON x = cx.id JOIN c cy ON y = cy.id WHERE 100 * m >= 85 * (cx.n + cy.n - m)),
  {_REACHED}
  SELECT d.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, d.id = component_id AS kept FROM d JOIN g ON a = d.id LEFT JOIN c ON c.id = d.id""",
    "op6_quality_rules": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM d),
  v AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM w WHERE len(w) >= {quality.WINDOW})),
  r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
  n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM r) GROUP BY 1),
  l AS (SELECT doc_id, x, b, len(list_filter(regexp_split_to_array(b, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
      len(list_filter(regexp_split_to_array(b, '[\x20\x09-\x0D]+'), lambda y: ends_with(y, '!!'))) AS shouts,
      length(b) - length(regexp_replace(b, '[#*$%&|<>{{}}\\^~_=]', '', 'g')) AS markup, length(b) - length(regexp_replace(b, '[|»›•]', '', 'g')) AS seps
    FROM (SELECT doc_id, x, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS b FROM (SELECT doc_id, unnest(ls) AS x FROM w))),
  f AS (SELECT *, b <> '' AND (markup * 10 > length(b) OR (shouts >= 3 AND shouts * 3 >= n) OR (seps >= 2 AND seps * 4 >= n)
      OR (n >= 4 AND NOT contains('.!?…:;"''”’»)]。！？', right(b, 1)) AND NOT regexp_matches(b, '[.,:;?!…#*`(){{}}=]'))
      OR (length(b) <= 200 AND n <= 12 AND regexp_matches(lower(b), '{quality.BOILERPLATE}'))) AS bad FROM l),
  k AS (SELECT doc_id, count(*) FILTER (b <> '') - count(DISTINCT x) FILTER (b <> '') AS n_dup_lines, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (NOT bad), 0) AS lasting FROM f GROUP BY 1),
  a AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, lasting FROM w JOIN k ON w.doc_id = k.doc_id LEFT JOIN n ON w.doc_id = n.doc_id)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND 100 * (word_chars - lasting) <= {quality.MAX_LOST_PERCENT} * word_chars AS kept FROM a""",
    "op9_line_dedup": r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM d),
  w AS (SELECT doc_id, i, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM l),
  s AS (SELECT doc_id, i, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) END) AS t FROM w WHERE len(w) > 0),
  u AS (SELECT doc_id, i, len(t) AS n, unnest(t) AS token FROM s),
  p AS (SELECT a.doc_id, a.i, a.n AS na, b.n AS nb, count(*) AS m FROM u a
      JOIN u b ON a.token = b.token AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i)) GROUP BY a.doc_id, a.i, a.n, b.doc_id, b.i, b.n),
  gone AS (SELECT DISTINCT doc_id, i FROM p WHERE 100 * m >= 80 * (na + nb - m)),
  k AS (SELECT l.doc_id, count(gone.i) AS n_removed, string_agg(x, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS kept
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id),
  c AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(kept, '')) AS kept_chars,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op7_embedding_dedup": f"""WITH RECURSIVE d AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
  u AS (SELECT * FROM d WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(v, lambda x: x <> 0)) > 0),
  l AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id < b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
  {_REACHED}
  SELECT d.id AS vec_id, (SELECT count(*) FROM e WHERE e.x = d.id) AS n_links, component_id, d.id = component_id AS kept FROM d JOIN g ON a = d.id""",
    "op12_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
  w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
  g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
  o AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
  k AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM o WHERE size >= 2),
  c AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a) // (l.a + r.a) AS score FROM k
      JOIN o l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN o r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1),
  i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))))) AS phrase
      FROM (SELECT *, string_split(phrase, ' ') AS w FROM o WHERE size >= 3)),
  m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, (SELECT sum(len(w)) FROM w WHERE w.lang = c.lang)::BIGINT AS n, score::BIGINT AS score
  FROM c LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""",
    "op13_warc": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
      regexp_replace(regexp_replace(trim(url), '^.*?://', ''), '#.*$', '') AS rest FROM pages),
  u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^.*@', '') AS host, substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS path FROM p),
  k AS (SELECT *, CASE WHEN rest IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(string_split(host, ':')[1], '^www\.', ''), '.')), ',')
      || CASE WHEN coalesce(string_split(host, ':')[2], '') IN ('', '80', '443') THEN '' ELSE ':' || string_split(host, ':')[2] END
      || ')' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END END AS url_key, max(page_id) OVER (PARTITION BY html) AS owner FROM u)
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to,
    url_key, row_number() OVER (ORDER BY url_key, page_id) AS history_rank, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture FROM k""",
}
