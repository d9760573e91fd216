"""Text of room labels: cleaning, similarity and the rules that tell a room's name from other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HANGUL = r"[\x{AC00}-\x{D7A3}\x{3130}-\x{318F}]"

# Fixed values, up to the patterns: texts that decide whether a label names a room.
KNOWN_WORDS = ["formal", "living", "dining", "kitchen", "bedroom", "bathroom", "office", "room"]
DESCRIPTORS = [
    "floor plan", "office plan", "building plan", "layout", "suite", "level", "floor", "wing", "zone", "area", "north", "south", "east", "west", "central",
    "entrance", "exit", "corridor", "hallway", "lobby", "elevator", "stairs", "emergency", "fire exit",
]
PLURAL_ROOMS = ["bedrooms", "bathrooms", "offices", "rooms"]
ROOM_PATTERNS = [
    r"^\d+/\d+\s*(bath|bathroom)$",
    r"^(half|quarter)\s*(bath|bathroom)$",
    r"^(powder|guest|master|en)\s*(room|bath|bathroom)$",
    r"^(walk|walk-in)\s*(closet|pantry)$",
    r"^(conference|meeting|board)\s*(room|hall)$",
    r"^(break|lunch|staff)\s*(room|area)$",
    r"^(server|storage|supply)\s*(room|closet)$",
    r"^(executive|private|corner)\s*(office|room)$",
]
ROOM_WORDS_KO = [
    "주방", "부엌", "거실", "응접실", "침실", "안방", "방", "화장실", "욕실", "변소", "식당", "다이닝", "서재", "공부방", "사무실", "현관", "입구", "베란다", "발코니",
    "다용도실", "세탁실", "창고", "저장실", "드레스룸", "옷장", "팬트리", "계단", "층계", "회의실", "미팅룸", "휴게실", "라운지", "임원실", "대표실",
]
DESCRIPTIVE_PATTERNS = [
    r"\d+\s*(bedrooms|bathrooms)",
    r"(bedrooms|bathrooms)\s*/\s*\d+",
    r"\d+\s*bed\s*/\s*\d+\s*bath",
    r"(sq\s*ft|square\s*feet|sqft)",
    r"(floor\s*plan|house\s*plan|plan\s*view|office\s*plan)",
    r"(scale|drawing|blueprint|architect)",
    r"(total|approx|approximately)",
    r"(main\s*floor|upper\s*floor|lower\s*floor)",
    r"(first\s*floor|second\s*floor|ground\s*floor)",
    r"(lot\s*size|home\s*size|building\s*size|office\s*size)",
    r"(suite\s*\d+|unit\s*\d+|floor\s*\d+)",
    r"(north|south|east|west|wing)",
]
#: Our own lists from here on, shorter than a full one; a list, or a table of terms, is a parameter of the rules.
WATERMARKS = ["alamy", "shutterstock", "stock", "getty", "dreamstime", "depositphotos", "istock", "123rf", "watermark", "www.", ".com", "©"]
#: Terms of the default vocabulary.
VOCABULARY_EN = [
    "living room", "bedroom", "master bedroom", "kitchen", "bathroom", "bath", "dining room", "laundry", "closet", "garage", "hall", "foyer", "study", "den", "pantry",
    "office", "porch", "deck", "patio", "family room", "great room", "utility", "storage", "nursery", "library", "balcony", "terrace", "mudroom", "powder room", "conference room",
]
VOCABULARY_KO = ["거실", "안방", "침실", "주방", "욕실", "화장실", "현관", "베란다", "발코니", "서재", "창고", "식당", "드레스룸", "다용도실", "회의실", "사무실"]


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def alternation(terms: list[str]) -> str:
    """A pattern for any of the terms as they stand."""
    escape = lambda t: "".join(f"\\{c}" if c in r".\+*?()[]{}|^$/-" else c for c in t)
    return "(" + "|".join(map(escape, terms)) + ")"


def similarity(a: Column, b: Column) -> Column:
    """Equal characters at equal places, over the longer length; 0 for two empty texts."""
    n, longest = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(places, F.lit(0), lambda s, i: s + (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))).cast("int"))
    return F.when(longest > 0, same / longest).otherwise(F.lit(0.0))


def contains_either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def clean_room_name(text: Column) -> Column:
    """A label without recognition artefacts: stray signs and letters, room numbers at the end, odd spacing and case."""
    trimmed = F.trim(text)
    broken = (F.length(trimmed) < 10) & (trimmed.contains("\\u") | trimmed.rlike(r"[\x{1F001}-\x{10FFFF}]"))
    plain = F.regexp_replace(trimmed, r"[^\p{L}\p{N}_\s/\-]", "")
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) | w.rlike(r"^\p{Nd}$") | (w.rlike("^[A-Za-z]$") & (F.size(words) > 1)))
    joined = F.array_join(kept, " ")
    keeps_number = joined.rlike(r"\d+/\d+") | F.lower(joined).rlike(r"(bath|bedroom|room)\s*\d+$")
    cut = F.when(keeps_number, joined).otherwise(F.regexp_replace(joined, r"\s+\d+$", ""))
    return F.when(broken, F.lit("")).otherwise(F.trim(F.when(has_hangul(cut), cut).otherwise(title_case(cut))))


def in_vocabulary(text: Column, terms: Column, least: int) -> Column:
    """Whether a term equals the text, is part of it or holds it; parts are longer than ``least`` characters."""
    part = lambda t: (F.contains(text, t) & (F.length(t) > least)) | (F.contains(t, text) & (F.length(text) > least))
    return F.exists(terms, lambda t: (t == text) | part(t))


def reject_reason(text: Column, confidence: Column, box: dict[str, Column], width: Column, height: Column, english: list[str] | None = None, korean: list[str] | None = None, watermarks: list[str] | None = None) -> Column:
    """The first rule that rejects a label as a room's name, null if none does. ``box`` has x1, y1, x2, y2.

    A null text counts as an empty one, a null confidence as 0. The lists are the defaults above where
    not given; see :mod:`floorlake.sources.vocabulary` for lists from tables.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    listed = lambda terms: F.split(F.lit("\n".join(terms)), "\n")  # noqa: E731  one constant, however long
    room = (
        low.rlike("|".join(ROOM_PATTERNS))
        | low.rlike(alternation(ROOM_WORDS_KO))
        | in_vocabulary(low, listed([x.lower() for x in english or VOCABULARY_EN]), 2)
        | in_vocabulary(t, listed(korean or VOCABULARY_KO), 1)
    )
    hangul = has_hangul(t)
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    cx, cy = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    rules = [
        (n == 0, "empty"),
        (n <= 1, "single_character"),
        ((F.coalesce(confidence, F.lit(0.0)) < 0.3) & ~low.rlike(alternation(KNOWN_WORDS)), "low_confidence"),
        (letters * 2 < n, "not_alphanumeric"),
        (low.rlike(alternation(watermarks or WATERMARKS)), "watermark"),
        (t.rlike(r"^\p{Nd}{1,2}$"), "number"),
        (~room & low.rlike("|".join(DESCRIPTIVE_PATTERNS)), "descriptive"),
        (~room & t.rlike(r"\d+.*\d+") & low.rlike(alternation(PLURAL_ROOMS)), "room_count"),
        (~room & low.rlike(alternation(DESCRIPTORS)), "descriptor"),
        (n > F.when(hangul, 20).otherwise(30), "too_long"),
        (n_words > F.when(hangul, 5).otherwise(3), "too_many_words"),
        (area < 20, "too_small"),
        (area > 8000, "too_large"),
        (cy < height * 0.20, "title_area"),
        (cy > height * 0.85, "legend_area"),
        ((cx < width * 0.05) | (cx > width * 0.95), "margin"),
    ]
    return F.coalesce(*[F.when(c, r) for c, r in rules])
