"""Text analysis as Column expressions: tokens, n-grams, stop words, light stemming, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}]+"
#: The English stop words of the public Lucene default list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null as none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without_stop_words(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def edge_ngrams(words: Column, low: int, high: int) -> Column:
    """The first ``low`` to ``high`` characters of every word."""
    cut = lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: F.substring(w, F.lit(1), n))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= low), cut))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` characters of every word."""

    def of(w: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(w)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= low), of))


def light_stem(word: Column) -> Column:
    """English plurals and the endings -ing, -ed, -ly taken off words that stay three letters long."""
    one = F.regexp_replace(word, "(?<=[a-z]{3})(ies)$", "y")
    two = F.regexp_replace(one, "(?<=[a-z]{2}(s|x|z|ch|sh))es$|(?<=[a-z]{2}[^su])s$", "")
    return F.regexp_replace(two, "(?<=[a-z]{3})(ing|ed|ly)$", "")


def english(text: Column) -> Column:
    """Tokens without stop words, stemmed."""
    return F.transform(without_stop_words(tokens(text)), light_stem)


def wildcard_like(pattern: str) -> str:
    """A pattern of * and ? (a backslash takes the next character as it is) as LIKE."""
    out, literal = [], False
    for c in pattern:
        if not literal and c == "\\":
            literal = True
            continue
        plain = literal or c not in "*?"
        out.append(("\\" + c if c in "%_\\" else c) if plain else {"*": "%", "?": "_"}[c])
        literal = False
    return "".join(out)


def swaps(term: str, times: int) -> dict[str, int]:
    """The term and what up to ``times`` swaps of neighbouring characters make of it, with the least number of swaps."""
    found, edge = {term: 0}, [term]
    for turn in range(1, times + 1):
        edge = [v for t in edge for k in range(len(t) - 1) if (v := t[:k] + t[k + 1] + t[k] + t[k + 2 :]) not in found]
        found |= dict.fromkeys(edge, turn)
    return found


def edit_distance(word: Column, term: str, most: int, transpositions: bool = False) -> Column:
    """Edits from ``term`` to the word, null beyond ``most``; a swap of neighbours costs one with ``transpositions``."""
    variants = swaps(term, most if transpositions else 0)
    costs = [F.when((d := F.levenshtein(word, F.lit(v), most - n)) >= 0, d + n) for v, n in variants.items()]
    return F.least(*costs) if len(costs) > 1 else costs[0]


def haversine_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    a, b = F.radians(lat), math.radians(to_lat)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin((F.radians(lon) - math.radians(to_lon)) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * 6371.0088)


def within_km(lat: Column, lon: Column, to_lat: float, to_lon: float, km: float) -> Column:
    """Points within a distance; a bounding box in front of the formula can be pushed into the scan."""
    reach = math.degrees(km / 6371.0088)
    box = lat.between(to_lat - reach, to_lat + reach)
    if abs(to_lat) + reach < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(to_lat)))))
        if -180 <= to_lon - wide and to_lon + wide <= 180:
            box = box & lon.between(to_lon - wide, to_lon + wide)
    return box & (haversine_km(lat, lon, to_lat, to_lon) <= km)
