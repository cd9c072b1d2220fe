"""Registered queries over names, renames, schedules and probe output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import media as md
from cairn.functions import names, paths, schedules
from cairn.operators import layout, renames
from cairn.queries import FILES, files
from cairn.registry import query
from cairn.sources import manifest as mf

# ---------------------------------------------------------------- names

_STATTED = "stem || ['', ' [12P 3V 1.2 GB]', ' [4V 7 kb] [1P 2 MB]  ', '[12 B]', ' [foo 7 GB]', ' [3 TB] end'][id % 6 + 1]"
_STAT_PATTERN = r"(\s+\[((\d+P(\s+\d+V)?)|(\d+V))?\s*\d+(\.\d+)?\s*(B|KB|MB|GB|TB|PB)\])+\s*$"


@query(f"WITH {FILES}, n AS (SELECT id, size, rtrim(regexp_replace({_STATTED}, '{_STAT_PATTERN}', '', 'i')) AS base FROM files) SELECT id, base, base || ' [' || id % 7 || 'P ' || (size % 1000) || ' B]' AS renamed FROM n")
def stat_names(spark, sf_dir):
    endings = F.array(*map(F.lit, ["", " [12P 3V 1.2 GB]", " [4V 7 kb] [1P 2 MB]  ", "[12 B]", " [foo 7 GB]", " [3 TB] end"]))
    name = F.concat("stem", F.element_at(endings, (F.col("id") % 6 + 1).cast("int")))
    count = (F.col("id") % 7).cast("string")
    renamed = names.stat_name(name, "{name} [{images}P {size}]", images=count, total_bytes=F.nullif(F.col("size") % 1000, F.lit(-1)))
    return files(spark, sf_dir).select("id", names.without_stat_suffixes(name).alias("base"), renamed.alias("renamed"))


#: One round of cleaning in SQL; the query repeats it until a round changes nothing.
_CLEANED = "rtrim(regexp_replace(rtrim(regexp_replace(rtrim(regexp_replace(name, '\\(copy\\)', '', 'gi')), '_$', '')), '^_', ''))"


@query(
    f"WITH RECURSIVE {FILES}, n AS (SELECT id, [repeat('(co', id % 23) || 'doc_(((copy)Copy)copy) ' || repeat('py)', id % 23), stem, ' _(copy)doc_(COPY)', '_' || repeat('_', id % 40) || 'x  '][id % 4 + 1] AS name FROM files), "
    f"r AS (SELECT id, rtrim(name) AS name, 0 AS round FROM n UNION ALL SELECT id, {_CLEANED}, round + 1 FROM r WHERE {_CLEANED} <> name) SELECT id, arg_max(name, round) AS cleaned FROM r GROUP BY 1"
)
def cleaned_names(spark, sf_dir):
    """Names of which some need dozens of rounds."""
    i = F.col("id")
    many = lambda text, n: F.repeat(F.lit(text), (i % n).cast("int"))
    nested = F.concat(many("(co", 23), F.lit("doc_(((copy)Copy)copy) "), many("py)", 23))
    name = F.when(i % 4 == 0, nested).when(i % 4 == 1, F.col("stem")).when(i % 4 == 2, F.lit(" _(copy)doc_(COPY)")).otherwise(F.concat(F.lit("_"), many("_", 40), F.lit("x  ")))
    return files(spark, sf_dir).select("id", names.cleaned_base(name, [r"\(copy\)", r"_$", r"^_"]).alias("cleaned"))


@query(f"WITH {FILES}, n AS (SELECT id, basename || ['', 'e' || chr(769), chr(233), chr(8491)][id % 4 + 1] AS name FROM files) SELECT id, nfc_normalize(name) <> name AS broken FROM n")
def filename_normal_form(spark, sf_dir):
    name = F.concat("basename", F.element_at(F.array(*map(F.lit, ["", "e\u0301", "\u00e9", "\u212b"])), (F.col("id") % 4 + 1).cast("int")))
    return files(spark, sf_dir).select("id", names.breaks_normal_form(name).alias("broken"))


_SPACED = "SELECT id, (id // 4) % 10 AS directory, CASE id % 4 WHEN 0 THEN ' n' || (id // 4) || '.txt' WHEN 1 THEN 'n' || (id // 4) || '.txt ' WHEN 2 THEN (CASE WHEN (id // 4) % 2 = 0 THEN 'N' ELSE 'm' END) || (id // 4) || '.txt' ELSE ' q' || (id // 4) || '<.txt' END AS name FROM files"


def _spaced(spark, sf_dir) -> DataFrame:
    k, which = F.floor(F.col("id") / 4), F.col("id") % 4
    number = k.cast("string")
    name = (
        F.when(which == 0, F.concat(F.lit(" n"), number, F.lit(".txt")))
        .when(which == 1, F.concat(F.lit("n"), number, F.lit(".txt ")))
        .when(which == 2, F.concat(F.when(k % 2 == 0, "N").otherwise("m"), number, F.lit(".txt")))
        .otherwise(F.concat(F.lit(" q"), number, F.lit("<.txt")))
    )
    return files(spark, sf_dir).select("id", (k % 10).alias("directory"), name.alias("name"))


@query(
    f"WITH {FILES}, n AS ({_SPACED}) SELECT directory, name, CASE WHEN id % 4 = 0 AND (id // 4) % 2 = 1 THEN trim(name) WHEN id % 4 = 1 AND (id // 4) % 2 = 1 AND NOT EXISTS (SELECT 1 FROM files f WHERE f.id = n.id - 1) THEN trim(name) END AS suggestion, "
    "CASE WHEN id % 4 = 3 THEN 'OTHER_ISSUES' WHEN (id // 4) % 2 = 0 AND EXISTS (SELECT 1 FROM files f WHERE f.id = (n.id // 4) * 4 + 2) THEN 'NAME_TAKEN' WHEN id % 4 = 1 AND EXISTS (SELECT 1 FROM files f WHERE f.id = n.id - 1) THEN 'NAME_TAKEN' END AS reason FROM n WHERE id % 4 <> 2"
)
def trim_suggestions(spark, sf_dir):
    return renames.trims(_spaced(spark, sf_dir))


# ---------------------------------------------------------------- renames

_MIXED = """e AS (SELECT (id // 3) % 50 AS directory, CASE WHEN id % 3 = 0 THEN CASE WHEN (id // 3) % 2 = 0 THEN 'xa' ELSE 'zz' END || (id // 3) || '.txt' WHEN id % 3 = 1 THEN 'a' || (id // 3) || '.txt' ELSE 'A' || (id // 3) || '.txt' END AS name,
    CASE WHEN id % 7 = 0 THEN 'directory' ELSE 'file' END AS kind FROM files)"""


def _mixed(spark, sf_dir) -> DataFrame:
    k, which = F.floor(F.col("id") / 3), F.col("id") % 3
    head = F.when(which == 0, F.when(k % 2 == 0, "xa").otherwise("zz")).when(which == 1, "a").otherwise("A")
    kind = F.when(F.col("id") % 7 == 0, "directory").otherwise("file")
    return files(spark, sf_dir).select((k % 50).alias("directory"), F.concat(head, k.cast("string"), F.lit(".txt")).alias("name"), kind.alias("kind"))


def _preview_sql(kind: str, new_name: str) -> str:
    return (
        f"WITH {FILES}, {_MIXED}, c AS (SELECT directory, name, {new_name} AS new_name FROM e WHERE kind = '{kind}'), d AS (SELECT * FROM c WHERE name <> new_name) "
        "SELECT directory, name, new_name, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.directory = d.directory AND lower(e.name) = lower(d.new_name)) THEN 'NAME_TAKEN' "
        "WHEN row_number() OVER (PARTITION BY directory, lower(new_name) ORDER BY name) > 1 THEN 'NAME_PROPOSED' END AS conflict FROM d"
    )


@query(_preview_sql("file", "'x' || name"))
def file_rename_preview(spark, sf_dir):
    return renames.preview(_mixed(spark, sf_dir), "file", "add_prefix", value="x")


@query(_preview_sql("directory", "CASE WHEN ends_with(name, '1.txt') THEN left(name, length(name) - 5) || '2.txt' ELSE name END"))
def directory_rename_preview(spark, sf_dir):
    return renames.preview(_mixed(spark, sf_dir), "directory", "replace_suffix", find="1.txt", value="2.txt", keep_extension=False)


@query(
    f"WITH {FILES}, n AS (SELECT absolute_path AS source, root_key || '/' || directory AS parent, row_number() OVER (ORDER BY absolute_path) AS number FROM files WHERE ext = 'jpg') "
    "SELECT source, parent || '/' || lpad(CAST(number + 4 AS VARCHAR), 6, '0') || '-' || split_part(parent, '/', -1) || '-p_' || regexp_replace(split_part(split_part(source, '/', -1), '.', 1), '[0-9]+', '#') || '_s.jpeg' AS target, CAST(NULL AS VARCHAR) AS conflict FROM n"
)
def batch_rename_numbered(spark, sf_dir):
    rule = renames.Rule(pattern="[0-9]+", replacement="#", prefix="p_", suffix="_s", with_parent=True, number_from=5, number_width=6, extension=(".JPG", ".jpeg"))
    return renames.batch(files(spark, sf_dir).select(F.col("absolute_path").alias("path")), rule)


@query(
    f"WITH {FILES}, n AS (SELECT absolute_path AS source, root_key || '/' || directory || '/' || 'doc_1' || CASE WHEN ext = 'txt' THEN '.dat' ELSE '.' || ext END AS target FROM files WHERE ext = 'txt') "
    "SELECT source, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY source) > 1 THEN 'TARGET_REPEATED' WHEN EXISTS (SELECT 1 FROM files f WHERE f.absolute_path = target) THEN 'TARGET_EXISTS' END AS conflict FROM n"
)
def batch_rename_conflicts(spark, sf_dir):
    rule = renames.Rule(pattern="[0-9]+", replacement="1", extension=(".txt", ".dat"))
    return renames.batch(files(spark, sf_dir).select(F.col("absolute_path").alias("path")), rule)


@query(
    f"WITH {FILES}, n AS (SELECT root_key, id, CASE WHEN id % 10 = 0 THEN 'n' || (id % 3) || '__dup00' || (2 + id % 4) || suffix WHEN id % 2 = 0 THEN 'N' || (id % 3) || suffix ELSE 'n' || (id % 3) || suffix END AS name FROM files), "
    "m AS (SELECT *, lower(name) AS folded, left(name, length(name) - length(regexp_extract(name, '\\.[^.]+$'))) AS head, regexp_extract(name, '\\.[^.]+$') AS tail, row_number() OVER (PARTITION BY root_key, lower(name) ORDER BY id) - 1 AS again FROM n), "
    "held AS (SELECT root_key, list(DISTINCT folded) AS every FROM m GROUP BY 1) "
    "SELECT root_key, name, id AS position, CASE WHEN again = 0 THEN name ELSE head || '__dup' || lpad(CAST(list_filter(range(2, again + 12), lambda k: NOT list_contains(every, lower(head) || '__dup' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || lower(tail)))[again] AS VARCHAR), "
    "CAST(greatest(3, length(CAST(list_filter(range(2, again + 12), lambda k: NOT list_contains(every, lower(head) || '__dup' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') || lower(tail)))[again] AS VARCHAR))) AS INTEGER), '0') || tail END AS new_name FROM m JOIN held USING (root_key)"
)
def other_names(spark, sf_dir):
    i = F.col("id")
    number = (i % 3).cast("string")
    name = (
        F.when(i % 10 == 0, F.concat(F.lit("n"), number, F.lit("__dup00"), (2 + i % 4).cast("string"), "suffix"))
        .when(i % 2 == 0, F.concat(F.lit("N"), number, "suffix"))
        .otherwise(F.concat(F.lit("n"), number, "suffix"))
    )
    return layout.allocate_names(files(spark, sf_dir).select("root_key", name.alias("name"), i.alias("position")), ["root_key"])


# ---------------------------------------------------------------- schedules


def _after(spark, sf_dir) -> DataFrame:
    return mf.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("after_utc"))


def _next(spark, sf_dir, rule: str, zone: str = "UTC") -> DataFrame:
    return schedules.next_occurrences(_after(spark, sf_dir), rule, zone).select("event_id", F.col("next_utc").cast("timestamp_ntz").alias("next_utc"))


@query("SELECT event_id, CAST(CASE WHEN hour(ts) * 60 + minute(ts) < 150 THEN date_trunc('day', ts) + INTERVAL 150 MINUTE ELSE date_trunc('day', ts) + INTERVAL 1590 MINUTE END AS TIMESTAMP) AS next_utc FROM events")
def next_runs(spark, sf_dir):
    return _next(spark, sf_dir, "30 2 * * *")


@query(
    "WITH d AS (SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '2023-12-25', TIMESTAMP '2027-01-01', INTERVAL 1 DAY)), t AS (SELECT CAST(timezone('UTC', timezone('America/New_York', day + INTERVAL 150 MINUTE)) AS TIMESTAMP) AS tick FROM d "
    "WHERE timezone('America/New_York', timezone('America/New_York', day + INTERVAL 150 MINUTE)) = day + INTERVAL 150 MINUTE) SELECT event_id, min(tick) AS next_utc FROM events JOIN t ON tick > ts AND tick < ts + INTERVAL 60 HOUR GROUP BY event_id"
)
def next_runs_new_york(spark, sf_dir):
    return _next(spark, sf_dir, "30 2 * * *", "America/New_York")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-02-29' THEN TIMESTAMP '2024-02-29' WHEN ts < TIMESTAMP '2028-02-29' THEN TIMESTAMP '2028-02-29' END AS next_utc FROM events")
def next_leap_days(spark, sf_dir):
    return _next(spark, sf_dir, "0 0 29 2 *")


@query("SELECT event_id, date_trunc('hour', ts) + to_minutes(CASE WHEN minute(ts) < 5 THEN 5 WHEN minute(ts) < 20 THEN 20 WHEN minute(ts) < 35 THEN 35 WHEN minute(ts) < 50 THEN 50 ELSE 65 END) AS next_utc FROM events")
def next_stepped_minutes(spark, sf_dir):
    return _next(spark, sf_dir, "5/15 * * * *")


@query(
    "WITH d AS (SELECT CAST(range AS TIMESTAMP) AS tick FROM range(TIMESTAMP '2023-12-01', TIMESTAMP '2027-01-01', INTERVAL 1 DAY) WHERE day(range) IN (1, 15) OR dayofweek(range) = 1), "
    "r AS (SELECT event_id, tick, row_number() OVER (PARTITION BY event_id ORDER BY tick) AS n FROM events JOIN d ON tick > ts AND tick < ts + INTERVAL 30 DAY) SELECT event_id, n, tick AS run_at FROM r WHERE n <= 3"
)
def next_three_runs(spark, sf_dir):
    found = schedules.occurrences(_after(spark, sf_dir), "0 0 1,15 * 1", "UTC", 3)
    spread = found.select("event_id", F.posexplode("times").alias("n", "run_at"))
    return spread.select("event_id", (F.col("n") + 1).cast("long").alias("n"), F.col("run_at").cast("timestamp_ntz").alias("run_at"))


# ---------------------------------------------------------------- media

_PAYLOADS = [
    '{"streams":[{"codec_type":"audio","codec_name":"aac"}],"format":{}}',
    '{"streams":"x"}',
    '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","width":1920,"height":1080,"codec_name":"h264","avg_frame_rate":"30000/1001","duration":"N/A"}],"format":{"duration":"12.5","bit_rate":"64000","format_name":"mov,mp4"}}',
    '{"streams":[{"codec_type":"video","width":0,"height":720,"codec_name":"vp9","avg_frame_rate":"0/0","r_frame_rate":"25/1"}],"format":{"duration":"1"}}',
    '{"streams":[{"codec_type":"video","width":"640","height":"480","codec_name":"","avg_frame_rate":"24","duration":"-1","bit_rate":"7"}]}',
    '{"streams":[{"codec_type":"video","codec_name":"av1","avg_frame_rate":"1/0"}],"format":{"duration":"inf","format_name":""}}',
]
_PROBED = """(VALUES (0, 'unknown', 'VIDEO_STREAM_NOT_FOUND', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (1, 'unknown', 'FFPROBE_OUTPUT_INVALID', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  (2, 'healthy', NULL, 1920, 1080, 'mov,mp4', 12.5, 'h264', 64000, 30000.0::DOUBLE / 1001, 'aac'), (3, 'corrupt', 'VIDEO_IMPOSSIBLE_METADATA', 0, 720, NULL, 1.0, 'vp9', NULL, 25.0, NULL),
  (4, 'corrupt', 'VIDEO_IMPOSSIBLE_METADATA', 640, 480, NULL, -1.0, NULL, 7, 24.0, NULL), (5, 'healthy', NULL, NULL, NULL, NULL, NULL, 'av1', NULL, NULL, NULL)) AS p(k, status, reason, width, height, format, duration_seconds, codec, bitrate, fps, audio_codec)"""


@query(
    f"SELECT event_id, status, reason, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, format, CAST(duration_seconds AS DOUBLE) AS duration_seconds, codec, CAST(bitrate AS BIGINT) AS bitrate, CAST(fps AS DOUBLE) AS fps, audio_codec FROM events JOIN {_PROBED} ON event_id % 6 = k"
)
def media_probe(spark, sf_dir):
    payload = F.element_at(F.array(*map(F.lit, _PAYLOADS)), (F.col("event_id") % 6 + 1).cast("int"))
    return mf.table(spark, sf_dir, "events").select("event_id", md.probed(payload).alias("p")).select("event_id", "p.*")


_MEDIA = "m AS (SELECT doc_id, ['image', 'video'][doc_id % 2 + 1] AS kind, ['healthy', 'corrupt', 'unknown'][doc_id % 3 + 1] AS integrity, ['unverified', 'baseline', 'verified', 'changed', 'unknown'][doc_id % 5 + 1] AS verification FROM documents)"


@query(f"WITH {_MEDIA} SELECT count(*) AS total, " + ", ".join(f"count_if({c} = '{v}') AS {n}" for c, v, n in md.SUMMARY) + " FROM m")
def media_counts(spark, sf_dir):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % by + 1).cast("int"))
    m = mf.table(spark, sf_dir, "documents").select(
        pick(["image", "video"], 2).alias("kind"), pick(["healthy", "corrupt", "unknown"], 3).alias("integrity"), pick(["unverified", "baseline", "verified", "changed", "unknown"], 5).alias("verification")
    )
    return md.summary(m)


# ---------------------------------------------------------------- paths


@query(f"WITH {FILES} SELECT id, root_key || '/' || split_part(relative_path, '/', 1) AS top, CASE WHEN starts_with(relative_path, 'en/') THEN substr(relative_path, 4) END AS below FROM files")
def top_directories(spark, sf_dir):
    relative = F.col("relative_path")
    return files(spark, sf_dir).select("id", paths.top_directory(F.col("root_key"), relative).alias("top"), paths.relative_to(relative, "en").alias("below"))


@query(
    f"WITH {FILES}, g AS (SELECT content_hash, root_key, min(directory) AS low, max(directory) AS high, count(*) AS n FROM files GROUP BY 1, 2 HAVING count(*) >= 2), "
    "l AS (SELECT *, CASE WHEN low = high THEN low WHEN split_part(low, '/', 1) = split_part(high, '/', 1) THEN split_part(low, '/', 1) ELSE '' END AS common FROM g) "
    "SELECT id, common, CASE WHEN directory = common THEN 'LCA_DIRECT' WHEN common = '' THEN split_part(directory, '/', 1) ELSE directory END AS bucket FROM files JOIN l USING (content_hash, root_key)"
)
def balance_buckets(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("directory", paths.parent(F.col("relative_path")))
    # the common directory of the least and the greatest path is that of all
    spans = f.groupBy("content_hash", "root_key").agg(F.min("directory").alias("low"), F.max("directory").alias("high"), F.count("*").alias("n")).filter("n >= 2")
    spans = spans.select("content_hash", "root_key", paths.common_prefix(F.col("low"), F.col("high")).alias("common"))
    return f.join(spans, ["content_hash", "root_key"]).select("id", "common", paths.balance_bucket(F.col("directory"), F.col("common")).alias("bucket"))
