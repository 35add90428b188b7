"""URL columns: resolving, canonical keys, the request guard, kinds of media and activities."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.config import SiteConfig
from lectern.functions.text import present

#: fixed values: endings of video and audio files
VIDEO = r"(?i)\.(mp4|webm|m4v|mov|avi|mkv|ogv|wmv|flv)(\?|$)"
AUDIO = r"(?i)\.(mp3|m4a|wav|ogg|oga|opus|flac|aac|wma)(\?|$)"
#: fixed values: hosts and endings of embedded videos
VIDEO_HOST = r"(?i)youtube\.com|youtu\.be|vimeo\.com|kaltura|dailymotion|panopto|ms-stream|stream\.microsoft|\.mp4|\.webm|\.m4v|\.mov"
#: fixed values: colour names that count as red
RED_NAMES = ("red", "darkred", "crimson", "firebrick", "maroon", "tomato", "orangered")


@F.pandas_udf(StringType())
def _join(href: pd.Series, base: pd.Series) -> pd.Series:
    def one(h, b):
        try:
            return None if h is None else urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def abs_url(href: Column, base: Column) -> Column:
    """href resolved against its page; null for anchors and for schemes that lead to no page."""
    ok = href.isNotNull() & ~F.trim(href).rlike(r"(?i)^(javascript|mailto|tel|data):|^#") & (F.trim(href) != "")
    return F.when(ok, _join(F.when(ok, F.trim(href)), base))


def query_param(url: Column, key: str) -> Column:
    return present(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1))


def without_param(url: Column, key: str) -> Column:
    url = F.regexp_replace(url, rf"([?&]){key}=[^&#]*(?:&|(?=#)|$)", "$1")
    return F.regexp_replace(url, r"[?&](?=#|$)", "")


def norm_url(url: Column) -> Column:
    """Key of an asset: no fragment, resource pages by id, without parameters that don't name content."""
    x = F.regexp_replace(url, "#.*$", "")
    kept = without_param(without_param(x, "forcedownload"), "redirect")
    return F.when(x.rlike(r"^[^?]*/mod/resource/view\.php(\?|$)"), F.concat(F.lit("resource:"), F.coalesce(query_param(x, "id"), F.lit("null")))).otherwise(kept)


def set_param(url: Column, key: str, value: Column) -> Column:
    """The address with a parameter set; the value is encoded."""
    value = F.url_encode(value)
    base, hash_ = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "(#.*)$", 1)
    has = base.rlike(rf"[?&]{key}=")
    new = F.when(has, F.regexp_replace(base, F.lit(rf"([?&]{key}=)[^&]*"), F.concat(F.lit("$1"), value))).otherwise(
        F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{key}="), value)
    )
    return F.concat(new, hash_)


def is_forbidden(url: Column, cfg: SiteConfig = SiteConfig()) -> Column:
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.coalesce((F.lower(origin) != cfg.origin) | url.rlike(cfg.forbidden), F.lit(True))


def split_guarded(df: DataFrame, url: str, cfg: SiteConfig = SiteConfig()) -> tuple[DataFrame, DataFrame]:
    """Rows whose url may be asked for, and one issue for each refused url (unparsable ones are dropped unreported)."""
    refused = is_forbidden(F.col(url), cfg)
    issues = (
        df.where(refused & F.col(url).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")).select(F.col(url).alias("url")).distinct()
        .select(F.lit("guard").alias("source"), F.lit("warning").alias("severity"), F.concat(F.lit("BLOCKED by GET guard (not requested): "), "url").alias("message"), "url")
    )
    return df.where(~refused), issues


def guarded(df: DataFrame, url: str, seen: Observation, cfg: SiteConfig = SiteConfig()) -> DataFrame:
    """Rows whose url may be asked for. In the same pass ``seen`` gets the numbers of allowed, refused and unparsable rows."""
    refused = is_forbidden(F.col(url), cfg)
    told = F.coalesce(F.col(url).rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(False))
    return df.observe(seen, F.count_if(~refused).alias("allowed"), F.count_if(refused & told).alias("refused"), F.count_if(~told).alias("unparsable")).where(~refused)


def media_kind(x: Column) -> Column:
    """video or audio by ending or media type, else null."""
    return F.when(x.rlike(VIDEO) | x.startswith("video/"), "video").when(x.rlike(AUDIO) | x.startswith("audio/"), "audio")


def skipped_media(x: Column, video: bool = False, audio: bool = False) -> Column:
    """Kind of media that isn't wanted, else null."""
    is_video, is_audio = x.rlike(VIDEO) | x.startswith("video/"), x.rlike(AUDIO) | x.startswith("audio/")
    return F.when(is_video & F.lit(not video), "video").when(is_audio & F.lit(not audio), "audio")


def activity_type(cls: Column, url: Column) -> Column:
    return F.coalesce(present(F.regexp_extract(cls, r"\bmodtype_(\w+)", 1)), present(F.regexp_extract(url, r"/mod/(\w+)/", 1)), F.lit("unknown"))


def module_id(data_id: Column, element_id: Column, url: Column) -> Column:
    return F.coalesce(present(data_id), present(F.regexp_extract(element_id, r"module-(\d+)", 1)), query_param(url, "id"))


def embed_kind(tag: Column, url: Column) -> Column:
    return F.when((tag == "video") | url.rlike(VIDEO_HOST), "🎥 Video").when(tag == "audio", "🔊 Audio").otherwise("🧩 Embedded")


def is_red_color(c: Column) -> Column:
    c = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    short, long = F.regexp_extract(c, r"^#([0-9a-f]{3})\b", 1), F.regexp_extract(c, r"^#([0-9a-f]{6})", 1)
    hex_ = F.when(short != "", F.regexp_replace(short, "(.)", "$1$1")).otherwise(long)
    from_hex = [F.conv(F.substring(hex_, i, 2), 16, 10).cast("int") for i in (1, 3, 5)]
    rgb = r"rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)"
    from_rgb = [F.regexp_extract(c, rgb, i).try_cast("int") for i in (1, 2, 3)]
    r, g, b = (F.when(hex_ != "", h).otherwise(d) for h, d in zip(from_hex, from_rgb, strict=True))
    return F.coalesce(c.isin(*RED_NAMES) | ((r >= 150) & (g <= 90) & (b <= 90)), F.lit(False))
