"""Scalar functions on transcript text and clock times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cues that the segmentation literature at hand was tuned with.
MARKER_TAGS = [
    ("now", r"\bnow\b"),
    ("next", r"\bnext\b"),
    ("move_on", r"\bmove on\b"),
    ("another_important", r"\banother important\b"),
    ("today_we", r"\btoday we (will|are going to)\b"),
    ("lets_move_on", r"\blet'?s move on\b"),
]
FILLERS = ["um", "uh", "okay", "so", "well", "alright"]


def clean(text: Column, mode: str = "strict") -> Column:
    """Cue text without markup. strict: tags and [labels] go, white space collapses; tags: [labels] stay; none: as it is."""
    if mode == "none":
        return text
    out = F.regexp_replace(F.regexp_replace(text, "\n", " "), "<[^>]+>", "")
    if mode == "strict":
        out = F.regexp_replace(out, r"\[(.*?)\]", "")
    elif mode != "tags":
        raise ValueError(f"unknown cleaning mode {mode!r}")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sentences(text: Column) -> Column:
    """The sentences of a text: cut at white space after . ! or ?, which stay; blank ones go."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def clock_seconds(clock: Column, strict: bool = False) -> Column:
    """Seconds of HH:MM:SS or MM:SS (fraction after . or ,). Anything else is null; with strict it stops the job, and
    only null stays null."""
    parts = F.split(F.replace(F.trim(clock), F.lit(","), F.lit(".")), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60.0 + x.try_cast("double"))
    found = F.when(F.size(parts).isin(2, 3), total)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("not a clock time: "), clock)).cast("double")
        found = F.when(clock.isNotNull(), F.coalesce(found, wrong))
    return found


def _hms(whole: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def hms_floor(seconds: Column) -> Column:
    """HH:MM:SS, fraction cut off."""
    return _hms(F.floor(seconds))


def hms_nearest(seconds: Column) -> Column:
    """HH:MM:SS of the nearest second, halves to even."""
    return _hms(F.bround(seconds, 0).cast("long"))


def _centis(seconds: Column) -> Column:
    return F.bround(seconds * 100, 0).cast("long")


def minutes_centis(seconds: Column) -> Column:
    """MM:SS.cc of the nearest hundredth, minutes unbounded."""
    c = _centis(seconds)
    return F.format_string("%02d:%02d.%02d", F.floor(c / 6000), F.floor(c % 6000 / 100), c % 100)


def millis_centis(millis: Column) -> Column:
    """MM:SS.cc of milliseconds, the seconds rounded by their exact binary value, so that 59.999 s are 00:60.00."""
    s = millis / 1000
    return F.concat(F.format_string("%02d:", F.floor(s / 60)), F.lpad(exact_text(s % 60, 2), 5, "0"))


def hms_centis(seconds: Column) -> Column:
    """HH:MM:SS.cc of the nearest hundredth."""
    c = _centis(seconds)
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c % 360000 / 6000), F.floor(c % 6000 / 100), c % 100)


def signed(x: Column, digits: int = 4) -> Column:
    """The number with its sign and so many digits, rounded by its exact binary value."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), exact_text(x, digits))


def named(value: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    """The label that a value has in a map of display names; another value stays, or gets ``otherwise``."""
    out = value if otherwise is None else F.lit(otherwise)
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def tick(flag: Column, yes: str = "\u2713", no: str = "\u00d7") -> Column:
    return F.when(flag, yes).otherwise(no)


def any_cue(text: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs, whatever the case."""
    return F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def cue_count(text: Column, words: list[str]) -> Column:
    """How often any of the words occurs as a word."""
    return F.regexp_count(text, F.lit(r"(?i)\b(" + "|".join(words) + r")\b"))


def cue_tags(text: Column, tagged: list[tuple[str, str]] = MARKER_TAGS) -> Column:
    """Names of the patterns that occur, joined by ; in the given order."""
    return F.concat_ws(";", *(F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(name)) for name, p in tagged))


def distance_bucket(distance: Column, tolerance: float = 30.0, middle: float = 120.0) -> Column:
    """Where a false positive lies: near a truth that another took, off by a moderate distance, or far from any."""
    return F.when(distance <= tolerance, "redundant_near_gt").when(distance <= middle, "offset_near_miss").otherwise("spurious_far")


def proximity_note(delta: Column, window: float) -> Column:
    near, far = F.concat(F.lit("yes Δ="), exact_text(delta, 1), F.lit("s")), F.concat(F.lit("no (nearest "), exact_text(delta, 0), F.lit("s)"))
    return F.when(delta.isNull(), "no").when(delta <= window, near).otherwise(far)


def exact_text(x: Column, digits: int) -> Column:
    """A number with so many digits, rounded by its exact binary value, halves to even."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def exact_round(x: Column, digits: int) -> Column:
    """Rounded by the exact binary value, halves to even, as binary-exact formatting has it."""
    return exact_text(x, digits).cast("double")


def short_note(text: Column, most: int = 80) -> Column:
    """Plain characters only; beyond ``most`` characters cut to most - 3 and three dots."""
    plain = F.trim(F.regexp_replace(text, "[^A-Za-z0-9 ,.'-]", ""))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most - 3)), F.lit("..."))).otherwise(plain)


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def safe_double(text: Column, default: float | None = None) -> Column:
    """The number in a text cell; blank or unreadable gives the default."""
    x = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(default))


def setting_id(prefix: str, **parts) -> str:
    """A setting's name from its parts: floats lose their point (0.55 is 055, 0.6 is 06), whole floats their fraction."""
    def say(x):
        return str(int(x)) if isinstance(x, float) and x >= 1 and x == int(x) else str(x).replace(".", "")

    return "_".join([prefix, *(f"{k}{say(v)}" for k, v in parts.items())])


def file_stem(path: Column, suffix: str = "") -> Column:
    """The file's name without folder, extension and the given suffix."""
    return F.regexp_extract(path, rf"([^/]+?){suffix}\.[^./]+$", 1)
