"""Scalar text functions as Column expressions. Java regular expressions carry (?U) where white space and word ends are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAPTION, ORDER = 1024, 2000
#: Unicode white space, as str.strip() takes it off, without the separators that only strip knows: what (?U)\\s matches, as a list of characters, which is trimmed many times faster than a pattern.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Words that make an order urgent.
URGENT = r"(?iuU)^\s*(срочно|urgent|p0)\b"
URGENT_HEAD = r"(?iuU)^\s*(срочно|urgent|p0)\b[\s,:—-]*"
# Deltas that count as no change, and signs of a rise and a fall.
FLAT, UP, DOWN = ("", "0", "—", "-", "–", "0%", "без изменений"), "+↑▲", "-−–↓▼"
# Colour words of a status.
COLOURS = {"зелёный": "green", "зеленый": "green", "green": "green", "ок": "green", "жёлтый": "amber", "желтый": "amber", "amber": "amber", "yellow": "amber", "красный": "red", "red": "red"}
# Emoji code point ranges.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"


def let(value: Column, use) -> Column:
    """use(value), value made once however often use names it. Within lambda functions Spark makes a repeated expression anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def escape(c: Column) -> Column:
    """& < > only, & first."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline(c: Column) -> Column:
    """Escaped, then **bold**, _italic_ and `code`, shortest match first."""
    bold = F.regexp_replace(escape(c), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    italic = F.regexp_replace(bold, r"(?U)(?<!\w)_(.+?)_(?!\w)", "<em>$1</em>")
    return F.regexp_replace(italic, r"`(.+?)`", "<code>$1</code>")


def clip(c: Column, limit: int = CAPTION) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def command(c: Column) -> Column:
    """The command of a message that starts with a slash, else null: up to the first space, lower-case, cut at @."""
    s = strip(c)
    head = F.substring_index(s, " ", 1)
    return F.when(F.startswith(s, F.lit("/")), F.substring_index(F.lower(F.substring(head, 2, 1_000_000_000)), "@", 1))


def rest(c: Column) -> Column:
    """What follows the command; the whole text if there is none."""
    s = strip(c)
    at = F.instr(s, " ")
    after = F.when(at > 0, strip(F.substring(s, at + 1, F.length(s)))).otherwise(F.lit(""))
    return F.when(F.startswith(s, F.lit("/")), after).otherwise(s)


def urgent(c: Column) -> Column:
    return F.rlike(c, F.lit(URGENT))


def without_urgency(c: Column) -> Column:
    return strip(F.regexp_replace(c, URGENT_HEAD, ""))


def sanitize(c: Column, limit: int = ORDER) -> Column:
    """Without control characters but line ends, trimmed, cut with a mark."""
    clean = strip(F.regexp_replace(c, r"[\x00-\x09\x0B-\x1F]", ""))
    cut = F.regexp_replace(F.substring(clean, 1, limit), r"(?U)\s+$", "")
    return F.when(F.length(clean) > limit, F.concat(cut, F.lit(" […обрезано]"))).otherwise(clean)


def lines(c: Column) -> Column:
    """Lines as str.splitlines gives them for \\n, \\r\\n and \\r: no empty last one."""
    split = F.split(newlines(c), "\n", -1)
    return F.when((F.size(split) > 0) & (F.element_at(split, -1) == ""), F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def first_line(c: Column, limit: int = 80) -> Column:
    line = F.get(F.split(newlines(strip(c)), "\n", 2), F.lit(0))
    short = F.concat(F.regexp_replace(F.substring(line, 1, limit - 3), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit("без текста")).when(F.length(line) <= limit, line).otherwise(short)


def quote(c: Column) -> Column:
    return F.array_join(F.transform(lines(c), lambda x: F.when(strip(x) == "", F.lit("  >")).otherwise(F.concat(F.lit("  > "), x))), "\n")


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)\s+", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.size(words(c))


def has_digit(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?U)\d"))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.!?])\s+", -1)


def delta_direction(c: Column) -> Column:
    d = strip(c)
    first = F.substring(d, 1, 1)
    return F.when(d.isin(*FLAT), "flat").when(first.isin(*UP), "up").when(first.isin(*DOWN), "down").otherwise("flat")


def metric_tile(c: Column) -> Column:
    """name | value | delta | note: padded to four, further bars stay in the note."""

    def tile(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        note = strip(F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), " | "))
        return F.struct(at(0).alias("name"), at(1).alias("value"), at(2).alias("delta"), let(at(2), delta_direction).alias("dir"), note.alias("note"))

    return let(F.transform(F.split(c, r"\|", -1), strip), tile)


def status(c: Column) -> Column:
    """Colour and text; an unknown colour is amber and keeps the whole text."""
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])

    def read(s: Column) -> Column:
        word = F.regexp_replace(F.lower(F.get(F.split(s, r"(?U)\s+", 2), F.lit(0))), r"^[:|,]+|[:|,]+$", "")
        after = F.coalesce(strip(F.get(F.split(s, r"(?U)\s+", 2), F.lit(1))), F.lit(""))
        return let(F.try_element_at(names, word), lambda colour: F.struct(F.coalesce(colour, F.lit("amber")).alias("color"), F.when(colour.isNull(), s).otherwise(after).alias("text")))

    return let(strip(c), read)


def plural_slides(n: Column) -> Column:
    """Russian endings: 1, 2 to 4, 5 and more, with the exception of 11 to 14."""
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    word = F.when((ten == 1) & (hundred != 11), "слайд").when(ten.isin(2, 3, 4) & ~hundred.isin(12, 13, 14), "слайда").otherwise("слайдов")
    return F.concat(n.cast("string"), F.lit(" "), word)


def caption(title: Column, meeting: Column, date: Column, slides: Column, fallback: Column) -> Column:
    """Non-empty parts joined; the number is left out where the title has it."""
    part = lambda c: F.nullif(strip(c), F.lit(""))
    said = F.contains(F.coalesce(title, F.lit("")), F.concat(F.lit("N"), strip(meeting))) | F.contains(F.coalesce(title, F.lit("")), F.concat(F.lit("№ "), strip(meeting)))
    number = F.when(part(meeting).isNotNull() & ~said, F.concat(F.lit("№ "), strip(meeting)))
    return F.concat_ws(" · ", F.coalesce(part(title), fallback), number, part(date), plural_slides(slides))


def table_rows(c: Column) -> Column:
    """Cells of the lines of a table: bars at the ends off, cells trimmed, short rows padded to the widest."""
    cells = F.transform(F.filter(lines(c), lambda r: F.startswith(strip(r), F.lit("|"))), lambda r: F.transform(F.split(F.regexp_replace(strip(r), r"^\|+|\|+$", ""), r"\|", -1), strip))
    width = F.array_max(F.transform(cells, F.size))
    return F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def has_header(rows: Column) -> Column:
    """The second row is made of dashes only."""
    return (F.size(rows) > 1) & F.forall(F.coalesce(F.get(rows, F.lit(1)), F.expr("cast(array() as array<string>)")), lambda x: F.rlike(x, F.lit(r"^:?-{2,}:?$")) | (x == ""))


def line_kind(s: Column) -> Column:
    """Kind of a trimmed line of a deck, by the first prefix that fits."""
    starts = lambda p: F.startswith(s, F.lit(p))
    return (
        F.when(s == "", "blank").when(starts("# "), "title").when(starts("## "), "sub").when(starts("- ") | (s == "-"), "bullets").when(starts("|"), "table")
        .when(starts("@metric "), "metrics").when(starts("@status "), "status").when(starts("@human"), "human").when(starts("> "), "note").otherwise("para")
    )


def backoff(attempt: Column, base: float = 1.5, cap: float = 30.0) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


#: What must not be in analytics: addresses, links, handles, long numbers. The order matters: an address holds a handle.
PERSONAL = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[email]"), (r"https?://[^\s]+", "[link]"), (r"@[A-Za-z0-9_]{3,}", "[handle]"), (r"\+?[0-9][0-9() -]{7,}[0-9]", "[number]"))


#: What a quotation must not name beyond that, as far as its form tells: dates of meetings, people by patronymic, initials or title, and postal addresses. A date comes before long numbers, which it may look like.
DATE = (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", "[date]")
NAMES = (
    (r"(?:[А-ЯЁ][а-яё]+ )?[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]*(?:вич|вна|ична|ьич)(?: [А-ЯЁ][а-яё]+)?", "[name]"), (r"[А-ЯЁ][а-яё]+ [А-ЯЁ]\. ?[А-ЯЁ]\.", "[name]"), (r"(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?", "[name]"),
    (r"(?:ул|пр|просп|пер|наб)\. ?[А-ЯЁ][а-яё-]+(?:, ?(?:д\. ?)?[0-9]+)?(?:, ?кв\. ?[0-9]+)?", "[address]"), (r"[0-9]+ [A-Z][a-z]+ (?:Street|Avenue|Road|Lane)", "[address]"),
)
#: Sentences of a quotation.
TWO_SENTENCES = r"^[^.!?…]*(?:[.!?…]+[^.!?…]*[.!?…]*)?"


def quotable(c: Column) -> Column:
    """The first two sentences of a text, without what could tell who or where someone is. That goes first, as the stops in initials, dates and addresses end no sentence."""
    c = F.trim(c)
    for pattern, mask in (*PERSONAL[:-1], DATE, PERSONAL[-1], *NAMES):
        c = F.regexp_replace(c, pattern, mask)
    return F.regexp_extract(c, TWO_SENTENCES, 0)


def scrub(c: Column) -> Column:
    for pattern, mask in PERSONAL:
        c = F.regexp_replace(c, pattern, mask)
    return c


def token_shape(c: Column) -> Column:
    """Looks like a bot token, by form alone."""
    return F.rlike(c, F.lit(r"^[0-9]{6,12}:[A-Za-z0-9_-]{30,}$"))
