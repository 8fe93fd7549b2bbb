"""Station-name parsing and token similarity with array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without identifying power in the two matchers.
BOILERPLATE = (
    "delhi", "new", "ncr", "india", "up", "uttar", "pradesh", "haryana",
    "rajasthan", "cpcb", "dpcc", "uppcb", "hspcb", "rspcb", "imd", "iitm",
    "sector", "phase", "nagar", "colony", "road", "marg", "crossing",
)
GENERIC = (
    "sector", "nagar", "colony", "road", "marg", "phase", "block", "area",
    "town", "vihar", "puram", "park", "garden", "extension", "crossing",
)
NOISE = (
    "delhi", "new", "ncr", "india", "dpcc", "cpcb", "uppcb", "hspcb", "ppcb",
    "rspcb", "imd", "iitm", "station", "the",
)
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")

# Id prefix of each city.
CITY_PREFIX = {
    "delhi": "DL", "new delhi": "DL",
    "gurugram": "HR", "faridabad": "HR", "sonipat": "HR", "rohtak": "HR", "palwal": "HR", "manesar": "HR",
    "ballabgarh": "HR", "dharuhera": "HR", "panchgaon": "HR", "bahadurgarh": "HR",
    "noida": "UP", "greater noida": "UP", "ghaziabad": "UP", "baghpat": "UP", "meerut": "UP", "modinagar": "UP",
    "khora": "UP", "loni": "UP",
    "bhiwadi": "RJ", "alwar": "RJ",
}
OTHER_PREFIX = "NC"

MIN_SCORE = 0.55
AGENCY_TAIL = r"[-–]\s*([A-Za-z]+)\s*$"


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def agency(name: Column) -> Column:
    """Agency after the trailing dash, upper case, else CAAQMS."""
    found = F.upper(F.regexp_extract(name, AGENCY_TAIL, 1))
    return F.when(found != "", found).otherwise(F.lit("CAAQMS"))


def _without_agency(name: Column) -> Column:
    return F.regexp_replace(name, AGENCY_TAIL, "")


def clean_name(name: Column) -> Column:
    """First comma part without the agency; the whole name if nothing is left."""
    head = F.trim(F.rtrim(F.regexp_replace(F.trim(_without_agency(name)), r"-+$", "")))
    first = F.trim(F.split(head, ",")[0])
    return F.when(first == "", name).otherwise(first)


def city_of(name: Column) -> Column:
    part = F.trim(F.get(F.split(_without_agency(name), ","), F.lit(1)))
    return F.when(part.isNull() | (part == ""), F.lit("Delhi")).otherwise(part)


def prefix_of(city: Column) -> Column:
    prefixes = F.create_map(*(F.lit(x) for pair in CITY_PREFIX.items() for x in pair))
    return F.coalesce(F.try_element_at(prefixes, F.lower(city)), F.lit(OTHER_PREFIX))


def _split_words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]+", " "))
    return F.array_distinct(F.filter(F.split(spaced, r" +"), lambda t: t != ""))


def words(name: Column) -> Column:
    """Distinct words of two or more characters."""
    return F.filter(_split_words(name), lambda t: F.length(t) > 1)


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))


def tokens(name: Column) -> Column:
    """Identifying words: no agency after the last ' - ', no noise; single letters only if Roman numerals."""
    head = F.regexp_replace(name, r"^(.*) - .*$", "$1")
    return F.filter(
        _split_words(head), lambda t: ~t.isin(*NOISE) & ((F.length(t) > 1) | t.isin(*ROMAN))
    )


def ordinals(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9]+$") | t.isin(*ROMAN))


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def distinctive(word: Column) -> Column:
    return ~word.isin(*GENERIC) & (F.length(word) >= 6)


def match_score(ours: Column, theirs: Column) -> Column:
    """-1 when numerals disagree, else Jaccard; 1 when ours is contained and shares a distinctive word."""
    a, b = ordinals(ours), ordinals(theirs)
    clash = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    shared = F.array_intersect(ours, theirs)
    contained = (F.size(shared) == F.size(ours)) & F.exists(shared, distinctive)
    return (
        F.when(clash, F.lit(-1.0))
        .when(F.size(shared) == 0, F.lit(0.0))
        .when(contained, F.lit(1.0))
        .otherwise(_jaccard(ours, theirs))
    )


def site_score(our_name: Column, our_agency: Column, their_name: Column) -> Column:
    """Jaccard of identifying words, 0 on a number clash, +0.05 when the agency is in their name."""
    return word_score(words(our_name), our_agency, words(their_name))


def word_score(ours: Column, our_agency: Column, theirs: Column) -> Column:
    """As ``site_score``, of the words of both names."""
    key_a, key_b = F.array_except(ours, _words(BOILERPLATE)), F.array_except(theirs, _words(BOILERPLATE))
    na, nb = numbers(ours), numbers(theirs)
    clash = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    bonus = F.when(F.array_contains(theirs, F.lower(our_agency)), F.lit(0.05)).otherwise(F.lit(0.0))
    return F.when(~F.arrays_overlap(key_a, key_b) | clash, F.lit(0.0)).otherwise(_jaccard(key_a, key_b) + bonus)


def meeting(known: Column, ours: bool) -> Column:
    """From the words of a name those by which ours and theirs meet just where ``word_score`` is above 0.

    Two names with numbers score if a number is in both, other pairs if any identifying word is. A word is marked by the case it
    serves: n numbers of both, w words where ours alone has numbers, o words where ours has none.
    """
    key, nums = F.array_except(known, _words(BOILERPLATE)), numbers(known)
    mark = lambda c, m: F.transform(c, lambda w: F.concat(F.lit(m), w))
    # ours with numbers meets theirs with (n) and without (w); ours without meets both by o
    some = F.concat(mark(nums, "n"), mark(key, "w" if ours else "o"))
    return F.when(F.size(nums) > 0, some).otherwise(mark(key, "o") if ours else F.concat(mark(key, "w"), mark(key, "o")))
