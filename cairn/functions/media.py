"""Media types by extension, and facts read from probe output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The extensions of each media type.
EXTENSIONS = {
    "image": ["jpg", "jpeg", "png", "webp", "gif", "bmp", "heic", "avif", "tiff", "svg"],
    "video": ["mp4", "mov", "mkv", "avi", "m4v", "mts", "m2ts", "webm", "ts", "flv", "wmv"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "ape", "opus"],
    "document": ["pdf", "doc", "docx", "txt", "md", "rtf", "odt", "xls", "xlsx", "ppt", "pptx", "csv"],
    "archive": ["zip", "tar", "gz", "tgz", "bz2", "tbz2", "xz", "txz", "7z", "rar", "iso"],
}


def normalized_extension(ext: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")


def media_type(ext: Column) -> Column:
    """The type of an extension with or without its dot; ``other`` for all unknown ones, none included."""
    bare, out = normalized_extension(ext), F.lit("other")
    for kind, known in EXTENSIONS.items():
        out = F.when(bare.isin(known), kind).otherwise(out)
    return out


def bucket_kind(ext: Column) -> Column:
    """P for images, V for videos, else Other."""
    kind = media_type(ext)
    return F.when(kind == "image", "P").when(kind == "video", "V").otherwise("Other")


def rational(rate: Column) -> Column:
    """``30000/1001`` or ``25`` as a double; null for anything that is no finite number."""
    top = F.split(rate, "/")
    value = F.when(F.size(top) == 2, F.try_divide(top[0].try_cast("double"), F.get(top, 1).try_cast("double"))).otherwise(rate.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def exif_time(text: Column) -> Column:
    """``2024:01:31 10:20:30`` as a timestamp; null where it is none."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy:MM:dd HH:mm:ss"))


def filesystem_id(text: Column) -> Column:
    """An unsigned 64-bit id written as ``u:<hex>``, or in decimal, as DECIMAL(20,0)."""
    return F.when(text.startswith("u:"), F.conv(F.substr(text, F.lit(3)), 16, 10)).otherwise(text).try_cast("decimal(20,0)")


#: What is read of a stream and of the container; numbers may come as text.
_STREAM = "codec_type: string, codec_name: string, width: string, height: string, duration: string, bit_rate: string, avg_frame_rate: string, r_frame_rate: string"
PROBE = f"streams array<struct<{_STREAM}>>, format struct<duration: string, bit_rate: string, format_name: string>"


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def _finite(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def probed(payload: Column) -> Column:
    """struct(status, reason, width, height, format, duration_seconds, codec, bitrate, fps, audio_codec) of a video's probe output.

    A payload without an array of streams, or without a video stream, says nothing (``unknown``); sizes that cannot be
    make it ``corrupt``.
    """
    p = F.from_json(payload, PROBE)
    video = F.get(F.filter(p.streams, lambda s: s.codec_type == "video"), F.lit(0))
    audio = F.get(F.filter(p.streams, lambda s: s.codec_type == "audio"), F.lit(0))
    width, height = video.width.try_cast("long"), video.height.try_cast("long")
    duration = F.coalesce(_finite(video.duration), _finite(p.format.duration))
    bitrate = F.coalesce(video.bit_rate.try_cast("long"), p.format.bit_rate.try_cast("long"))
    fps = F.coalesce(rational(video.avg_frame_rate), rational(video.r_frame_rate))
    impossible = F.coalesce(width <= 0, F.lit(False)) | F.coalesce(height <= 0, F.lit(False))
    for number in (duration, bitrate, fps):
        impossible |= F.coalesce(number < 0, F.lit(False))
    reason = F.when(p.streams.isNull(), "FFPROBE_OUTPUT_INVALID").when(video.isNull(), "VIDEO_STREAM_NOT_FOUND").when(impossible, "VIDEO_IMPOSSIBLE_METADATA")
    status = F.when(p.streams.isNull() | video.isNull(), "unknown").when(impossible, "corrupt").otherwise("healthy")
    known = {
        "width": width, "height": height, "format": _present(p.format.format_name), "duration_seconds": duration,
        "codec": _present(video.codec_name), "bitrate": bitrate, "fps": fps, "audio_codec": _present(audio.codec_name),
    }
    return F.struct(status.alias("status"), reason.alias("reason"), *(F.when(video.isNotNull(), c).alias(n) for n, c in known.items()))


#: Counts of the summary: column, value, name.
SUMMARY = [
    ("kind", "image", "image"),
    ("kind", "video", "video"),
    ("integrity", "healthy", "healthy"),
    ("integrity", "corrupt", "corrupt"),
    ("integrity", "unknown", "unknown"),
    *(("verification", v, f"verification_{v}") for v in ("unverified", "baseline", "verified", "changed", "unknown")),
]


def summary(media: DataFrame) -> DataFrame:
    """All counts of a media table (kind, integrity, verification) in one pass."""
    return media.agg(F.count("*").alias("total"), *(F.count_if(F.col(c) == v).alias(n) for c, v, n in SUMMARY))
