"""Normalisation and extraction on noisy recognised text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import truthy

#: words that look like set codes but are not; add the names of one's own games
NOT_SETS = frozenset("TM TCG EN JP FOIL".split())
#: words of rules texts that say little
COMMON_RULES = frozenset("all and card cards each for from game hand into player players same search target that the their then this until when where with your".split())
#: words of rules texts that survive recognition, strongest first
STRONG_RULES = "library remove spell shuffles graveyard sorcery instant counter".split()


def straight(text: Column) -> Column:
    """Curly apostrophes made straight."""
    return F.translate(text, "’‘", "''")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slips_fixed(text: Column) -> Column:
    """Lower case, with usual slips of recognition put right in their fixed order."""
    out = collapsed(straight(F.lower(text)))
    for wrong, right in ((r"\bdower\b", "power"), (r"\bdee\s+sey\b", "seeker"), (r"\bdee\b", "see")):
        out = F.regexp_replace(out, wrong, right)
    return out


def letters(text: Column) -> Column:
    """How many letters the text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def letter_ratio(text: Column) -> Column:
    return letters(text) / F.greatest(F.length(text), F.lit(1))


def title_signal(text: Column) -> Column:
    """Whether a text looks like a name: mostly letters, or two words of three letters side by side."""
    return (letter_ratio(text) >= 0.55) | text.rlike(r"[A-Za-z]{3,}\s+[A-Za-z]{3,}")


def collector_number(text: Column) -> Column:
    """The first 2 to 4 digits with at most one letter, such as 045 of 045/280; null without one."""
    return truthy(F.lower(F.regexp_extract(text, r"\b(\d{2,4}[A-Za-z]?)\s*(?:/\s*\d{2,4})?\b", 1)))


def set_code(text: Column, blocked: frozenset[str] = NOT_SETS) -> Column:
    """The first code of 3 to 5 characters, in upper case, that has two letters and isn't blocked."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z0-9]{3,5})\b"), 1)
    fits = F.filter(found, lambda c: (F.length(F.regexp_replace(c, "[^A-Z]", "")) >= 2) & ~c.isin(*sorted(blocked)))
    return F.try_element_at(fits, F.lit(1))


def mana_cost(text: Column) -> Column:
    """Converted cost of a text such as {2}{W/U}{G}; without braces digits and colour letters count. 0 is null."""
    inner = F.regexp_extract_all(F.upper(text), F.lit(r"\{([^}]*)\}"), 1)
    worth = lambda s: F.when(s.rlike("^[0-9]+$"), s.try_cast("int")).when(s.contains("/"), 1).when(s.rlike("^[WUBRGXC]$"), 1).otherwise(0)
    braced = F.aggregate(F.transform(inner, worth), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    digits = F.aggregate(F.regexp_extract_all(text, F.lit(r"([0-9])"), 1), F.lit(0), lambda a, x: a + x.cast("int"))
    loose = digits + F.length(F.regexp_replace(F.upper(text), "[^WUBRG]", ""))
    return F.nullif(F.when(F.size(inner) > 0, braced).otherwise(loose), F.lit(0))


def possessive_title(text: Column) -> Column:
    """A name such as Urza's Saga within a text."""
    return truthy(F.regexp_extract(text, r"([A-Z][A-Za-z]+'s\s+[A-Z][A-Za-z\-' ]+)", 1))


def strongest_tokens(text: Column, least: int, most: int) -> Column:
    """Distinct lower-case words of at least ``least`` letters, longest first and then by alphabet, at most ``most``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z']{{{least},}})"), 1))
    order = F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(order, lambda s: s["w"]), 1, most)


def rules_normalised(text: Column) -> Column:
    """Lower-case letters and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z ]", " "), " +", " "))


def rules_query(text: str) -> tuple[list[str], list[str]]:
    """The strong words and the query words of a recognised rules text, on the driver."""
    import re

    said = re.sub(" +", " ", re.sub("[^a-z ]", " ", text.lower())).strip()
    strong = [w for w in STRONG_RULES if w in said]
    rest = sorted({w for w in re.findall("[a-z]{4,}", said)} - COMMON_RULES - set(strong), key=lambda w: (-len(w), w))
    return strong, (strong + rest)[:6]


def rules_predicate(description: Column, strong: list[str], query: list[str]) -> Column:
    """All of at most three strong words if there are two; else any query word."""
    low = F.lower(description)
    if len(strong) >= 2:
        return reduce(lambda a, b: a & b, (low.contains(w) for w in strong[:3]))
    return reduce(lambda a, b: a | b, (low.contains(w) for w in query), F.lit(False))


def rules_bonus(said: Column, described: Column) -> Column:
    """What phrases that both texts share, or only one has, add to their similarity."""
    both = lambda w: said.contains(w) & described.contains(w)
    only = lambda w: said.contains(w) & ~described.contains(w)
    part = lambda test, x: F.when(test, x).otherwise(0.0)
    return (
        part(both("remove"), 0.04) + part(both("game"), 0.03) + part(both("shuffles"), 0.03) + part(both("same name"), 0.03)
        + part(both("instant") & both("sorcery"), 0.12) + part(only("instant"), -0.08) + part(only("sorcery"), -0.08)
        + part(both("remove") & both("from the game"), 0.08)
    )


RULES_PHRASES = ("remove", "game", "shuffles", "same name", "instant", "sorcery", "from the game")


def rules_bonus_of(said: frozenset[str], described: frozenset[str]) -> float:
    """``rules_bonus`` of two texts by the ``RULES_PHRASES`` that they contain, added in the same order."""
    both = lambda w: w in said and w in described
    only = lambda w: w in said and w not in described
    parts = (
        (both("remove"), 0.04), (both("game"), 0.03), (both("shuffles"), 0.03), (both("same name"), 0.03), (both("instant") and both("sorcery"), 0.12),
        (only("instant"), -0.08), (only("sorcery"), -0.08), (both("remove") and both("from the game"), 0.08),
    )
    total = 0.0
    for test, x in parts:
        total += x if test else 0.0
    return total


def stripped_noise(text: Column) -> Column:
    """A title without leading non-letters and without short lower-case words at either end."""
    words = F.filter(F.split(F.regexp_replace(text, "^[^A-Za-z]+", ""), r"\s+"), lambda w: w != "")
    solid = F.transform(words, lambda w: (F.length(w) >= 3) | w.rlike("^[A-Z]"))
    first = F.array_position(solid, True)
    last = F.size(words) - F.array_position(F.reverse(solid), True) + 1
    return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), (last - first + 1).cast("int")), " "))
