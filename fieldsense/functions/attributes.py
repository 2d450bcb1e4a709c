"""Call attributes from descriptive text: a value is a label for words that occur verbatim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words and phrases that name each attribute value.
PITCH = {"high": r"\bhigh[- ]pitched\b", "low": r"\b(?:low|lo)[- ]pitched\b"}
QUIET = (
    r"\bnot very loud\b|\blow-volume\b|\bvery little volume\b|\bnot have a lot of volume\b|\bnot produce much volume\b"
    r"|\bquiet\b(?! waters?\b)|\bweak\b|\bfaint(?:ly)?\b"
)
MODERATE = r"\bmoderately loud\b"
LOUD = r"\b(?:very )?loud\b|\bdeafening\b"
STRUCTURE = {
    "trill": r"\btrill\w*",
    "series_of": r"\bseries of\b",
    "click_knock": r"\bclicks?\b|\bknock\w*",
    "snore_rattle": r"\bsnor\w*|\brattl\w*",
    "peep_plink": r"\bpeep\w*|\bplink\w*",
    "whistle": r"\bwhistl\w*",
    "bleat_groan_growl": r"\bbleat\w*|\bgroan\w*|\bgrowl\w*",
    "croak_quack_ribit": r"\bcroak\w*|\bquack\w*|\brib-it\b|\bkrek-ek\b",
    "chuckle_cluck": r"\bchuckl\w*|\bcluck\w*",
    "drone_bellow": r"\bdrone\b|\bbellow\b",
    "grunt": r"\bgrunt\w*",
}
NUMBER = r"(\d+(?:\.\d+)?|1/2|one)"
#: Pattern, group of the lower end (0: none), group of the upper end or its value.
DURATION = [
    (NUMBER + r"\s*-\s*" + NUMBER + r"\s*seconds?", 1, 2),
    (r"lasting up to " + NUMBER + r" seconds?", 0, 1),
    (r"less than " + NUMBER + r" seconds?", 0, 1),
    (r"(?:averaging|about) " + NUMBER + r" seconds?", 1, 1),
    (NUMBER + r" seconds? to almost a minute", 1, "60"),
]
NOTES_PER_SECOND = NUMBER + r"\s*-\s*" + NUMBER + r" notes per second"
RISING = {"rising": r"\brising\b", "descending": r"\bdescending\b"}
UNDERWATER = r"\bunderwater\b|\bunder water\b"
CAPTION_START, RELEASE = "This is a", r"release call"


def any_case(pattern: str) -> str:
    return f"(?i)(?:{pattern})"


def _parts(text: Column) -> Column:
    return F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))


def _describes(s: Column) -> Column:
    return (s != "") & ~s.startswith(CAPTION_START) & ~s.rlike(any_case(RELEASE))


def described(text: Column) -> Column:
    """Sentences that describe the call: no captions, no release calls."""
    return F.filter(_parts(text), _describes)


def _says(s: Column) -> Column:
    """Whether a sentence holds any of the words: most sentences don't, and only those that do are looked at by attribute.
    Patterns that begin words are tried where words begin."""
    patterns = [*PITCH.values(), QUIET, MODERATE, LOUD, *STRUCTURE.values(), *RISING.values(), UNDERWATER]
    at_words = "|".join(p.removeprefix(r"\b").replace(r"|\b", "|") for p in patterns)
    return s.rlike(any_case(rf"\b(?:{at_words})")) | s.rlike(any_case("|".join(p for p, *_ in [*DURATION, (NOTES_PER_SECOND,)])))


def _occurs(sentences: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(sentences, lambda s: s.rlike(any_case(pattern))), F.lit(False))


def _one_of(flags: dict[str, Column]) -> Column:
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def _number(s: Column) -> Column:
    return F.when(s == "1/2", 0.5).when(F.lower(s) == "one", 1.0).otherwise(s.try_cast("double"))


def _first(sentences: Column, pattern: str) -> Column:
    return F.get(F.filter(sentences, lambda s: s.rlike(any_case(pattern))), F.lit(0))


def _flags(sentences: Column) -> dict[str, Column]:
    """Whether each kind of word occurs, by attribute and value."""
    bare = F.transform(sentences, lambda s: F.regexp_replace(s, any_case(f"{MODERATE}|{QUIET}"), " "))
    out = {f"pitch:{k}": _occurs(sentences, p) for k, p in PITCH.items()}
    out |= {"loudness:moderate": _occurs(sentences, MODERATE), "loudness:quiet": _occurs(sentences, QUIET), "loudness:loud": _occurs(bare, LOUD)}
    out |= {f"structure:{k}": _occurs(sentences, p) for k, p in STRUCTURE.items()} | {f"rising_pitch:{k}": _occurs(sentences, p) for k, p in RISING.items()}
    return out | {"underwater:": _occurs(sentences, UNDERWATER)}


#: Patterns whose first sentence counts.
FIRSTS = {f"duration:{i}": p for i, (p, *_) in enumerate(DURATION)} | {"notes:": NOTES_PER_SECOND}


def _values(flags: dict[str, Column], firsts: dict[str, Column]) -> dict[str, Column]:
    """Column by attribute from what occurs and the first sentences of FIRSTS."""
    of = lambda name: {k.split(":")[1]: c for k, c in flags.items() if k.startswith(f"{name}:")}
    group = lambda s, p, g: _number(F.regexp_extract(s, any_case(p), g))
    duration = None
    for i, (pattern, lo, hi) in enumerate(DURATION):
        s = firsts[f"duration:{i}"]
        low = group(s, pattern, lo) if lo else F.lit(None).cast("double")
        pair = F.array(low, F.lit(float(hi)) if isinstance(hi, str) else group(s, pattern, hi))
        duration = F.when(s.isNotNull(), pair) if duration is None else duration.when(s.isNotNull(), pair)
    notes = firsts["notes:"]
    structure = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in of("structure").items()]))
    return {
        "pitch": _one_of(of("pitch")),
        "loudness": _one_of(of("loudness")),
        "duration_s": duration,
        "notes_per_s": F.when(notes.isNotNull(), F.array(group(notes, NOTES_PER_SECOND, 1), group(notes, NOTES_PER_SECOND, 2))),
        "structure": F.when(F.size(structure) > 0, structure),
        "rising_pitch": _one_of(of("rising_pitch")) == "rising",
        "underwater": F.when(flags["underwater:"], True),
    }


def attributes(sentences: Column) -> dict[str, Column]:
    """Column by attribute; null where nothing is said or what is said conflicts."""
    return _values(_flags(sentences), {k: _first(sentences, p) for k, p in FIRSTS.items()})


def evidence(df: DataFrame, key: str, sentences: str) -> DataFrame:
    """(key, place, field, match, sentence): the words that decided each value, in order, each once a sentence whatever its
    case. Loud words count where no moderate or quiet phrase holds them; of durations, notes and water the first words
    count."""

    said = df.select(key, F.filter(sentences, _says).alias(sentences))

    def words(field: str, pattern: str, without: str | None = None) -> Column:
        looked = lambda s: s if without is None else F.regexp_replace(s, any_case(without), " ")
        in_one = lambda s: F.transform(F.regexp_extract_all(looked(s), F.lit(any_case(pattern)), 0), lambda m: F.struct(F.lit(field).alias("field"), m.alias("match"), s.alias("sentence")))
        return F.flatten(F.transform(sentences, in_one))

    def first(*lists: Column) -> Column:
        return F.slice(F.concat(*lists), 1, 1)

    found = [words("pitch", p) for p in PITCH.values()] + [words("loudness", MODERATE), words("loudness", QUIET), words("loudness", LOUD, f"{MODERATE}|{QUIET}")]
    found += [first(*[words("duration_s", p) for p, *_ in DURATION]), first(words("notes_per_s", NOTES_PER_SECOND))]
    found += [words("structure", p) for p in STRUCTURE.values()] + [words("rising_pitch", p) for p in RISING.values()] + [first(words("underwater", UNDERWATER))]
    listed = said.select(key, F.concat(*found).alias("all"))
    names = listed.select(key, "all", F.transform("all", lambda e: F.struct(e["field"], F.lower(e["match"]), e["sentence"])).alias("names"))
    unique = names.select(key, F.filter("all", lambda e, i: F.array_position("names", F.get("names", i)) == i + 1).alias("all"))
    # From posexplode() Spark would infer a filter on the array and push it, with all it takes to compute it, below.
    return unique.select(key, F.posexplode_outer("all").alias("place", "e")).filter("place is not null").select(key, "place", "e.field", "e.match", "e.sentence")


def group_attributes(texts: DataFrame, group: str, member: str, text: str) -> DataFrame:
    """group + its attributes: by the sentences of all its members' whole texts, members in order.

    Each text is judged by itself; of a group only decisions meet: whether any text has a kind of word, and the first
    sentence that counts, by member and place. So a group of any size is a few numbers and sentences in each task.
    """
    parts = texts.select(group, F.col(member).alias("__m"), _parts(F.col(text)).alias("__p"))
    told = parts.select(group, "__m", F.exists("__p", _describes).alias("__told"), F.filter("__p", lambda s: _says(s) & _describes(s)).alias("__s"))
    told = told.select(group, "__told", "__s", F.transform("__s", lambda s, i: F.struct(F.col("__m").alias("m"), i.alias("i"), s.alias("s"))).alias("__at"))
    flags = _flags(F.col("__s"))
    named = {k: k.replace(":", "__") for k in [*flags, *FIRSTS]}
    first = lambda p: F.get(F.filter("__at", lambda e: e["s"].rlike(any_case(p))), F.lit(0))
    found = told.select(group, "__told", *(c.alias(named[k]) for k, c in flags.items()), *(first(p).alias(named[k]) for k, p in FIRSTS.items()))
    met = found.groupBy(group).agg(F.bool_or("__told").alias("__told"), *(F.bool_or(named[k]).alias(named[k]) for k in flags), *(F.min(named[k]).alias(named[k]) for k in FIRSTS))
    values = _values({k: F.col(named[k]) for k in flags}, {k: F.col(named[k])["s"] for k in FIRSTS})
    return met.filter("__told").select(group, *(c.alias(k) for k, c in values.items()))


def reviewed(extracted: Column, approved: Column) -> Column:
    """Whether the approved values are the extracted ones, nulls included."""
    return extracted.eqNullSafe(approved)
