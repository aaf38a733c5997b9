"""Column functions over clock, quarter, score and team texts. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Team codes that a scoreboard shows, and spellings that stand for one of them.
TEAM_CODES = (
    "ATL", "BKN", "BOS", "CHA", "CHI", "CLE", "DAL", "DEN", "DET", "GSW", "GS", "HOU", "IND", "LAC", "LAL", "MEM",
    "MIA", "MIL", "MIN", "NOP", "NYK", "NY", "OKC", "ORL", "PHI", "PHX", "POR", "SAC", "SAS", "SA", "TOR", "UTA", "WAS",
)
TEAM_ALIASES = {
    "UTAH": "UTA", "UIA": "UTA", "UT4": "UTA", "DENN": "DEN", "OEN": "DEN", "NETS": "BKN", "METS": "BKN", "NCTS": "BKN",
    "BROOKLYN": "BKN", "MAGIC": "ORL", "ORLANDO": "ORL",
}
NOT_TEAMS = ("ST", "ND", "RD", "TH", "Q", "QTR", "PER", "PTS", "TOL", "BON")
# Letters that are read for digits.
LOOKALIKES = ("ODILZASGB", "001124568")
EVENT_KEYWORDS = (("BLOCK", "Block"), ("STEAL", "Steal"))

_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))


def iso_clock_seconds(clock: Column) -> Column:
    """Seconds of `PT11M38.00S`; null gives 0, any other text that does not match gives null (see strict_iso_clock)."""
    pattern = r"^PT(?:(\d+)M)?(\d+(?:\.\d+)?)S$"
    minutes, seconds = F.regexp_extract(clock, pattern, 1), F.regexp_extract(clock, pattern, 2)
    value = F.coalesce(minutes.try_cast("double"), F.lit(0.0)) * 60 + seconds.try_cast("double")
    return F.when(clock.isNull(), F.lit(0.0)).otherwise(value)


def strict_iso_clock(clock: Column) -> Column:
    """As iso_clock_seconds, but malformed text ends the query."""
    value = iso_clock_seconds(clock)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("unreadable clock: "), clock)).cast("double")).otherwise(value)


def quarter_key(text: Column) -> Column:
    """What a quarter is told by: letters and digits, usual misreadings put right."""
    t = F.regexp_replace(F.upper(_text(text)), "[^0-9A-Z]", "")
    return F.replace(F.replace(F.replace(t, F.lit("OQ"), F.lit("0Q")), F.lit("5T"), F.lit("ST")), F.lit("S1"), F.lit("ST"))


def quarter_of(t: Column) -> Column:
    """The quarter of a quarter_key. It looks at the key several times, so the key is best a column of its own."""
    out = F.when(t.endswith("ST"), "1Q").when(t.endswith("ND"), "2Q").when(t.endswith("RD"), "3Q").when(t.endswith("TH"), "4Q")
    return out.when(t.rlike("^[1-4]Q$"), t).when(t.isin("OT", "0T"), "OT").otherwise("")


def quarter_text(text: Column) -> Column:
    """A quarter reading as 1Q to 4Q or OT, '' if it is none. Ordinal endings win over other forms."""
    return quarter_of(quarter_key(text))


def quarter_number(quarter: Column) -> Column:
    """1 to 4, 5 for overtime, else null."""
    t = F.upper(F.trim(_text(quarter)))
    return F.when(t.rlike("^[1-4]Q$"), F.substring(t, 1, 1).try_cast("int")).when(t == "OT", 5)


def clock_key(text: Column) -> Column:
    """A reading with look-alike letters and separators of a clock as they are meant."""
    return F.translate(F.upper(F.trim(_text(text))), "OIL|;.", "011:::")


def clock_numbers(t: Column) -> tuple[Column, Column]:
    """Minutes and seconds in a clock_key, null without."""
    pattern = r"(\d{1,2})\s*:\s*(\d{2})"
    return tuple(F.when(t.contains(":"), F.regexp_extract(t, pattern, g).try_cast("int")) for g in (1, 2))


def clock_of(m: Column, s: Column) -> Column:
    """The clock of clock_numbers."""
    return F.when((m <= 15) & (s <= 59), F.concat(F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"))).otherwise("")


def clock_text(text: Column) -> Column:
    """A clock reading as MM:SS of at most 15:59, '' if it is none; look-alike letters and separators are read as meant."""
    return clock_of(*clock_numbers(clock_key(text)))


def clock_seconds(clock: Column) -> Column:
    """Seconds of M:SS or MM:SS of at most 15:59, else null."""
    t = F.trim(_text(clock))
    m, s = (F.regexp_extract(t, r"^(\d{1,2}):(\d{2})$", g).try_cast("int") for g in (1, 2))
    return F.when((m <= 15) & (s <= 59), m * 60 + s)


def lenient_clock_seconds(text: Column) -> Column:
    """Seconds of M:SS, or of 3 or 4 bare digits whose last two are seconds; null if seconds pass 59 or minutes 12."""
    t = F.regexp_replace(F.translate(F.upper(F.trim(_text(text))), "OIL;.", "011::"), "[^0-9:]", "")
    t = F.when(t.rlike(r"^\d{3,4}$"), F.regexp_replace(t, r"^(\d{1,2})(\d{2})$", "$1:$2")).otherwise(t)
    m, s = (F.regexp_extract(t, r"^(\d{1,2}):(\d{1,2})$", g).try_cast("int") for g in (1, 2))
    return F.when((m <= 12) & (s <= 59), m * 60 + s)


def seconds_clock(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("int"))
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def game_clock(period: Column, seconds: Column) -> Column:
    """`Q2 06:48`."""
    return F.concat(F.lit("Q"), period.cast("int").cast("string"), F.lit(" "), seconds_clock(seconds))


def analysis_time(seconds: Column) -> Column:
    """HH:MM:SS."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two((s % 3600) / 60), two(s % 60))


def digits(text: Column) -> Column:
    """The digits of a reading, look-alike letters included."""
    return F.regexp_replace(F.translate(F.upper(_text(text)), *LOOKALIKES), "[^0-9]", "")


def team_code(text: Column) -> Column:
    """The team of a reading: the longest alias it contains, else the first code; '' for clocks, quarters and labels."""
    compact = F.replace(F.upper(_text(text)), F.lit(" "), F.lit(""))
    t = F.regexp_replace(compact, "[^A-Z]", "")
    rules = [(a, TEAM_ALIASES[a]) for a in sorted(TEAM_ALIASES, key=lambda a: (-len(a), a))] + [(c, c) for c in TEAM_CODES]
    found = reduce(lambda acc, r: acc.when(t.contains(r[0]), r[1]), rules[1:], F.when(t.contains(rules[0][0]), rules[0][1])).otherwise("")
    return F.when((quarter_text(compact) != "") | (clock_text(compact) != "") | (F.length(t) < 2) | t.isin(*NOT_TEAMS), "").otherwise(found)


def event_name(kind: Column, description: Column) -> Column:
    """The event type, or one told by a keyword of the description where the type is empty."""
    squeeze = lambda c: F.regexp_replace(F.trim(_text(c)), r"\s+", " ")
    out = F.when(squeeze(kind) != "", squeeze(kind))
    for word, name in EVENT_KEYWORDS:
        out = out.when(F.upper(_text(description)).contains(word), name)
    return out.otherwise("")



def clean_text(value: Column) -> Column:
    """Trimmed text; '' for null, nan and none."""
    t = F.trim(_text(value))
    return F.when(F.lower(t).isin("nan", "none"), "").otherwise(t)


def team_order(team: Column) -> tuple[Column, Column]:
    """Sort keys of team ids: by number, those that are none last."""
    return F.coalesce(team.try_cast("double").try_cast("int"), F.lit(999999)), team


def clean_team_id(value: Column) -> Column:
    """Team ids as text: '' for null, blank, nan, none and unknown, and no trailing .0; anything else stays."""
    t = F.trim(_text(value))
    return F.when(F.lower(t).isin("nan", "none", "unknown"), "").otherwise(F.regexp_replace(t, r"\.0$", ""))
