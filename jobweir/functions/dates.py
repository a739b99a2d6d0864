"""Ages of postings and lengths of runs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ascii_lower, trimmed

_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
_UTC = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC$"


def _seconds(posted_at: Column) -> Column:
    """Seconds since 1970 of the two time shapes; null for others.

    Worked out from the text, so that the session's time zone plays no part.
    """
    shape = posted_at.rlike(_RFC3339) | posted_at.rlike(_UTC)
    local = F.try_to_timestamp(
        F.concat(F.translate(F.left(posted_at, F.lit(19)), "Tt", "  "), F.lit("+00:00")),
        F.lit("yyyy-MM-dd HH:mm:ssXXX"),
    )
    zone = F.regexp_extract(posted_at, r"([+-])(\d\d):(\d\d)$", 0)
    minutes = F.when(zone == "", F.lit(0)).otherwise(
        F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
        * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    )
    return F.when(shape, F.unix_timestamp(local) - minutes * 60)


def age_days(posted_at: Column, now_seconds: Column) -> Column:
    """Whole days since, 0 at least; from phrases too; null where unknown."""

    def days(p: Column) -> Column:
        low = ascii_lower(p["phrase"])
        said = F.regexp_extract(p["phrase"], r"^(\d+)\+? Days? Ago$", 1).try_cast("int")
        return (
            F.when(p["seconds"].isNotNull(), _days(p["seconds"], now_seconds))
            .when(low == "today", 0)
            .when(low == "yesterday", 1)
            .otherwise(said)
        ).cast("int")

    return _once(_parsed(posted_at), days)


def _days(seconds: Column, now_seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((now_seconds - seconds) / 86400)).cast("bigint")


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _phrase(posted_at: Column) -> Column:
    return trimmed(F.regexp_replace(posted_at, r"^(Posted )+", ""))


def _parsed(posted_at: Column) -> Column:
    return F.struct(_seconds(posted_at).alias("seconds"), _phrase(posted_at).alias("phrase"))


def age_text(posted_at: Column, now_seconds: Column) -> Column:
    """"12d", ">30d", or the phrase itself; "?" for null."""

    def text(p: Column) -> Column:
        low = ascii_lower(p["phrase"])
        number = F.regexp_extract(p["phrase"], r"^(\d+) Days? Ago$", 1)
        more = F.regexp_extract(p["phrase"], r"^(.*)\+ Days? Ago$", 1)
        return (
            F.when(p["seconds"].isNotNull(), F.concat(_days(p["seconds"], now_seconds).cast("string"), F.lit("d")))
            .when(low == "today", "0d")
            .when(low == "yesterday", "1d")
            .when(p["phrase"].rlike(r"\+ Days? Ago$"), F.concat(F.lit(">"), more, F.lit("d")))
            .when(number != "", F.concat(number, F.lit("d")))
            .otherwise(p["phrase"])
        )

    return F.when(posted_at.isNull(), "?").otherwise(_once(_parsed(posted_at), text))


def duration_text(ms: Column) -> Column:
    """A length in milliseconds as "423ms", "47s", "1min 34s", "1h 5min 23s" or "2d 3h 12min"."""

    def unit(size: int, of: int | None = None) -> Column:
        n = F.floor(ms / (1000 * size))
        return (n if of is None else n % of).cast("bigint").cast("string")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return (
        F.when(ms < 1000, text(ms.cast("bigint").cast("string"), "ms"))
        .when(ms < 60_000, text(unit(1), "s"))
        .when(ms < 3_600_000, text(unit(60), "min ", unit(1, 60), "s"))
        .when(ms < 86_400_000, text(unit(3600), "h ", unit(60, 60), "min ", unit(1, 60), "s"))
        .otherwise(text(unit(86400), "d ", unit(3600, 24), "h ", unit(60, 60), "min"))
    )


def tags_text(remote: Column, status: Column) -> Column:
    return F.concat_ws(
        " ",
        F.when(remote, "[remote]"),
        F.when(status == "applied", "[applied]"),
        F.when(status == "dismissed", "[dismissed]"),
    )
