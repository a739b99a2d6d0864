"""Remote flags of the sources, and host sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import ascii_lower, has_any

#: Hosts that are no employer's (fixed values).
SOCIAL = (
    "facebook.com", "www.facebook.com", "x.com", "twitter.com", "www.twitter.com", "linkedin.com",
    "www.linkedin.com", "youtube.com", "www.youtube.com", "instagram.com", "www.instagram.com",
    "tiktok.com", "www.tiktok.com", "github.com", "google.com",
)
SOCIAL_AND_CHAT = SOCIAL + ("medium.com", "discord.com", "discord.gg", "slack.com", "t.me")


def from_offices(location: Column, offices: Column) -> Column:
    """Remote if the location or any office says so; never null."""
    words = ("remote", "anywhere", "work from home")

    def says(x: Column) -> Column:
        return F.coalesce(has_any(x, words), F.lit(False))

    some = F.exists(offices, lambda o: says(o["name"]) | says(o["location"]))
    return says(location) | F.coalesce(some, F.lit(False))


def exactly(x: Column) -> Column:
    """Remote if x is the word "remote"; null for null."""
    return ascii_lower(x) == "remote"


def from_flag_or_place(flag: Column, location: Column, place_type: Column) -> Column:
    """The flag; else the location text, if any; else whether the type is "2"."""
    return F.coalesce(flag, has_any(location, ("remote",)), place_type == "2")


def from_location(location: Column) -> Column:
    return has_any(location, ("remote", "anywhere"))


def from_location_or_tags(location: Column, tags: Column) -> Column:
    words = ("remote", "anywhere", "worldwide")
    return F.when(
        location.isNotNull(), has_any(location, words) | F.coalesce(has_any(tags, words), F.lit(False))
    )
