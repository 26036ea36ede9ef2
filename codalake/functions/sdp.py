"""Session descriptions: format parameters (a=fmtp), receiver limits and negotiation, as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parameters(fmtp: Column, lower: bool = False) -> Column:
    """array<struct<k, v>> of the trimmed non-empty parts; v is null for a part without '='."""
    def one(x: Column) -> Column:
        at = F.instr(x, "=")
        key = F.trim(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x))
        return F.struct((F.lower(key) if lower else key).alias("k"), F.when(at > 0, F.trim(F.substring(x, at + 1, F.length(x)))).alias("v"))

    return F.transform(F.filter(F.transform(F.split(fmtp, ";"), lambda x: F.trim(x)), lambda x: x != ""), one)


def _cap(params: Column, key: str) -> tuple[Column, Column]:
    """The value of a positive whole-number parameter (null if absent), and whether it is valid (once at most)."""
    found = F.filter(params, lambda x: x["k"] == key)
    text = F.get(found, 0)["v"]
    number = F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("bigint"))
    return number, (F.size(found) == 0) | ((F.size(found) == 1) & F.coalesce(number > 0, F.lit(False)))


def _caps(fmtp: Column, lower: bool, required: bool) -> Column:
    def of(params: Column) -> Column:
        fr, fr_ok = _cap(params, "max-fr")
        fs, fs_ok = _cap(params, "max-fs")
        ok = fr_ok & fs_ok & ~F.exists(params, lambda x: x["v"].isNull())
        if required:
            ok = ok & fr.isNotNull() & fs.isNotNull()
        return F.when(ok, F.struct(F.coalesce(fr, F.lit(0)).alias("max_fr"), F.coalesce(fs, F.lit(0)).alias("max_fs")))

    return let(parameters(fmtp, lower), of)


def vp8_caps(fmtp: Column) -> Column:
    """max_fr and max_fs, both mandatory, keys as written; null if invalid."""
    return _caps(fmtp, lower=False, required=True)


def vp9_caps(fmtp: Column) -> Column:
    """max_fr and max_fs, each 0 if absent, keys in either case; null if invalid."""
    return _caps(fmtp, lower=True, required=False)


def is_profile_0(fmtp: Column) -> Column:
    found = F.filter(parameters(fmtp, lower=True), lambda x: x["k"] == "profile-id")
    return (F.size(found) == 0) | F.exists(found, lambda x: x["v"] == "0")


def fmtp(max_fr: Column, max_fs: Column) -> Column:
    return F.concat(F.lit("max-fr="), max_fr.cast("string"), F.lit(";max-fs="), max_fs.cast("string"))


def macroblocks(width: Column, height: Column) -> Column:
    """16x16 blocks that cover the frame; null without a positive size."""
    return F.when((width > 0) & (height > 0), F.floor((width + 15) / 16) * F.floor((height + 15) / 16))


def _allows(caps: Column, width: Column, height: Column, fps: Column, most: int) -> Column:
    """Each side has floor(sqrt(8 * max_fs)) blocks at most; a cap of 0 is no limit."""
    side = lambda x: F.floor((x + 15) / 16)

    def of(c: Column) -> Column:
        limit = F.floor(F.sqrt(c["max_fs"].cast("double") * 8))
        slow = (c["max_fr"] == 0) | (fps <= c["max_fr"])
        small = (c["max_fs"] == 0) | ((macroblocks(width, height) <= c["max_fs"]) & (side(width) <= limit) & (side(height) <= limit))
        return F.when(c.isNotNull() & (fps > 0) & width.between(1, most) & height.between(1, most), slow & small)

    return let(caps, of)


def vp8_allows_frame(caps: Column, width: Column, height: Column, fps: Column) -> Column:
    """Whether a frame size and rate fit vp8_caps; null without valid caps, a positive rate or a valid size."""
    return _allows(caps, width, height, fps, 16383)


def vp9_allows_frame(caps: Column, width: Column, height: Column, fps: Column) -> Column:
    """The same for vp9_caps, whose absent limits allow everything."""
    return _allows(caps, width, height, fps, 65536)


DIRECTIONS = ["sendrecv", "sendonly", "recvonly", "inactive"]
ACTIVE, RECEIVES, SENDS = ["sendrecv", "sendonly", "recvonly"], ["sendrecv", "recvonly"], ["sendrecv", "sendonly"]


def with_profile_0(fmtp_: Column) -> Column:
    return F.concat(F.lit("profile-id=0;"), fmtp_)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def media_sections(sdp: Column) -> Column:
    """array<struct<media, active, payloads, direction, lines>> of the m= sections, in lower case. The direction is the section's
    last one, or else the session's; a port of zeros is not active; a section with less than four fields has no media."""
    lines = F.transform(F.split(F.lower(sdp), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    parts = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), "\nm=")
    direction = lambda of: F.element_at(F.transform(F.filter(of, lambda x: x.isin(*[f"a={d}" for d in DIRECTIONS])), lambda x: F.substring(x, 3, 10)), -1)
    last = lambda of, default: F.when(F.exists(of, lambda x: x.isin(*[f"a={d}" for d in DIRECTIONS])), direction(of)).otherwise(default)
    session = last(F.split(F.get(parts, 0), "\n"), F.lit("sendrecv"))

    def section(part: Column) -> Column:
        own = F.split(part, "\n")
        head = _words(F.get(own, 0))
        whole = F.size(head) >= 4
        port = F.regexp_replace(F.substring_index(F.get(head, 1), "/", 1), "^0+", "")
        return F.struct(
            F.when(whole, F.get(head, 0)).otherwise("").alias("media"),
            (whole & (port != "")).alias("active"),
            F.when(whole, F.slice(head, 4, F.greatest(F.size(head), F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("payloads"),
            last(own, session).alias("direction"),
            own.alias("lines"),
        )

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), section)


def _attributes(section: Column, name: str) -> Column:
    """Fields of the a=<name>: lines that name one of the section's payload types."""
    own = F.transform(F.filter(section["lines"], lambda x: x.startswith(f"a={name}:")), lambda x: _words(F.substring(x, len(name) + 4, 1_000_000)))
    return F.filter(own, lambda x: (F.size(x) >= 2) & F.array_contains(section["payloads"], F.get(x, 0)))


def has_payload(sections: Column, codec: str, directions: list[str], fits=None) -> Column:
    """Whether an active video section (of media_sections) with one of the directions binds the codec (as vp8/90000) to one of its payload types.
    fits(params, all_params): a further condition on the payload's last format parameters (null without any) and all of them."""

    def one(section: Column) -> Column:
        maps = F.filter(_attributes(section, "rtpmap"), lambda x: F.get(x, 1) == codec)
        if fits is None:
            bound = F.size(maps) > 0
        else:
            formats = _attributes(section, "fmtp")
            text = lambda x: F.array_join(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), " ")
            of = lambda pt: F.transform(F.filter(formats, lambda x: F.get(x, 0) == pt), text)
            last = lambda pt: F.when(F.size(of(pt)) > 0, F.element_at(of(pt), -1))
            bound = F.exists(maps, lambda x: fits(last(F.get(x, 0)), of(F.get(x, 0))))
        return (section["media"] == "video") & section["active"] & section["direction"].isin(*directions) & bound

    return F.exists(sections, one)


def vp8_negotiates(sections: Column, directions: list[str] = ACTIVE) -> Column:
    return has_payload(sections, "vp8/90000", directions)


def vp8_receives_frame(sections: Column, width: Column, height: Column, fps: Column) -> Column:
    """Whether a section receives VP8 and declares no limit below the frame; limits that are declared must be valid."""

    def fits(params: Column, _: Column) -> Column:
        declared = F.exists(parameters(params), lambda x: x["k"].isin("max-fr", "max-fs"))
        return params.isNull() | ~declared | F.coalesce(vp8_allows_frame(vp8_caps(params), width, height, fps), F.lit(False))

    return has_payload(sections, "vp8/90000", RECEIVES, fits)


def vp9_negotiates(sections: Column, directions: list[str] = ACTIVE) -> Column:
    """The same for VP9 profile 0: a payload without format parameters, or with some that name profile 0 or none."""
    return has_payload(sections, "vp9/90000", directions, lambda params, every: params.isNull() | F.exists(every, is_profile_0))


def vp9_receives_frame(sections: Column, width: Column, height: Column, fps: Column) -> Column:
    def fits(params: Column, every: Column) -> Column:
        return params.isNull() | (F.exists(every, is_profile_0) & F.coalesce(vp9_allows_frame(vp9_caps(params), width, height, fps), F.lit(False)))

    return has_payload(sections, "vp9/90000", RECEIVES, fits)
