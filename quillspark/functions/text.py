"""Column functions on strings, times, arrays, maps and JSON. All are built-in expressions but html_unescape."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Breaks of lines besides \n.
BREAKS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TIME = r"(?:\d+:)?\d{2}:\d{2}[.,]\d{3}"
#: Image references in a page's Markdown: the older placeholder, the comment and the Markdown image.
PLACEHOLDER = r"\[\[IMAGE \d{3}(?: \| [^\]]+)*\]\]"
COMMENT = r"<!--\s*IMAGE\s+(\d{3})(?::\s*[^>]*)?\s*-->"
IMAGE = r"!\[IMAGE (\d{3})\]\("


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then`` of the value, which is computed once however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_case(c: Column | str) -> Column:
    """Case-folded for comparisons: upper case first, as letters of one upper case are equal; ß is ss, every sigma is one, and a dotless i stays one."""
    apart = F.translate(col(c), "\u0131", "\ue000")
    return F.replace(F.translate(F.lower(F.upper(apart)), "\u03c2\ue000", "\u03c3\u0131"), F.lit("\u00df"), F.lit("ss"))


def parse_time(c: Column | str) -> Column:
    """``[H:]MM:SS.mmm`` (or a comma) to seconds; null where it is no time."""

    def seconds(parts: Column) -> Column:
        n = F.size(parts)
        minutes, hours = F.try_element_at(parts, F.lit(-2)).try_cast("int"), F.when(n == 3, F.try_element_at(parts, F.lit(-3)).try_cast("int")).otherwise(0)
        return F.when(n.isin(2, 3), hours * 3600 + minutes * 60 + F.element_at(parts, -1).try_cast("double"))

    return let(F.split(F.translate(col(c), ",", "."), ":"), seconds)


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


#: Not to be computed anew for each condition on the result.
_unescape = _unescape.asNondeterministic()


def html_unescape(c: Column | str) -> Column:
    """Entities to characters; Python sees only rows with an ampersand (the condition is tested before)."""
    return F.when(F.contains(col(c), F.lit("&")), _unescape(F.when(F.contains(col(c), F.lit("&")), col(c)))).otherwise(col(c))


def strip_markup(c: Column | str) -> Column:
    """Without inline stamps, then without tags: what stands escaped is no tag yet."""
    return F.regexp_replace(F.regexp_replace(col(c), r"<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>", ""), "<[^>]+>", "")


def tidy_blanks(c: Column | str) -> Column:
    """Without zero-width characters, and all white space as single blanks."""
    plain = F.regexp_replace(F.regexp_replace(col(c), "[\ufeff\u200b]", ""), "\u00a0", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_cue_text(c: Column | str) -> Column:
    return tidy_blanks(html_unescape(strip_markup(c)))


def tokens(c: Column | str) -> Column:
    """Split at white space; a blank text has no tokens."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")), " "), "")


def token_key(t: Column | str) -> Column:
    """Lower case without marks; a token of marks alone is its own key."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(col(t)), r"(?U)[\W_]+", ""), F.lit("")), col(t))


def word_count(t: Column | str) -> Column:
    return F.size(F.filter(col(t), lambda x: x.rlike("[A-Za-z0-9]")))


def ends_sentence(t: Column | str) -> Column:
    return F.coalesce(F.try_element_at(col(t), F.lit(-1)).rlike(r"[.!?][\"')\]]?$"), F.lit(False))


def format_text(t: Column | str) -> Column:
    text = F.regexp_replace(F.array_join(col(t), " "), r"(?U)\s+([,.;:!?%])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)([(\[{])\s+", "$1"), r"(?U)\s+([)\]}])", "$1")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: A prime, so that sums and products of smaller numbers stay within a long.
_PRIME, _BASE = (1 << 31) - 1, 1_000_003
#: Up to so many sizes are compared element by element; beyond, all are told apart by hashes in one pass.
_FEW = 4


def overlap(a: Column | str, b: Column | str, limit: int) -> Column:
    """The largest n for which the last n of a equal the first n of b; 0 if none, or where either is null.

    Only sizes at which both outer tokens agree are compared. Where those are many (a word said over and over) one pass
    over the tokens keeps a hash of b's beginning and of a's end and the largest size at which they agree, which is
    then compared; so the work grows with the number of tokens, not with its square.
    """
    return let(F.struct(col(a).alias("a"), col(b).alias("b")), lambda pair: _overlap(pair["a"], pair["b"], limit))


def _overlap(a: Column, b: Column, limit: int) -> Column:
    most = F.least(F.size(a), F.size(b), F.lit(limit))
    at = lambda x, i: F.get(x, i)
    same = lambda n: F.slice(a, -n, n) == F.slice(b, F.lit(1), n)
    sizes = F.sequence(F.lit(1), F.greatest(most, F.lit(1)))
    outer = F.filter(sizes, lambda n: (n <= most) & at(a, F.size(a) - n).eqNullSafe(at(b, F.lit(0))) & at(a, F.size(a) - 1).eqNullSafe(at(b, n - 1)))
    by_search = lambda found: F.coalesce(F.array_max(F.filter(found, same)), F.lit(0))
    code = lambda x: F.pmod(F.xxhash64(x), F.lit(_PRIME))

    def step(s: Column, n: Column) -> Column:
        head = F.pmod(s["head"] * _BASE + code(at(b, n - 1)), F.lit(_PRIME))
        end = F.pmod(code(at(a, F.size(a) - n)) * s["power"] + s["end"], F.lit(_PRIME))
        return F.struct(head.alias("head"), end.alias("end"), F.pmod(s["power"] * _BASE, F.lit(_PRIME)).alias("power"), F.when(head == end, n).otherwise(s["best"]).alias("best"))

    zero = F.lit(0).cast("long")
    by_hash = F.aggregate(sizes, F.struct(zero.alias("head"), zero.alias("end"), F.lit(1).cast("long").alias("power"), F.lit(0).alias("best")), step)["best"]
    # Equal hashes of different tokens are as good as impossible; should they occur, the search decides.
    checked = lambda best, found: F.when((best == 0) | same(F.greatest(best, F.lit(1))), best).otherwise(by_search(found))
    found = F.transform(F.array(F.struct(outer.alias("sizes"))), lambda s: F.when(F.size(s["sizes"]) == 0, 0).when(F.size(s["sizes"]) <= _FEW, by_search(s["sizes"])).otherwise(F.transform(F.array(by_hash), lambda n: checked(n, s["sizes"]))[0]))
    return F.when(most > 0, found[0]).otherwise(0)


def sanitize_text_layer(c: Column | str) -> Column:
    text = F.regexp_replace(col(c), "[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), r"(?U)^\s+|\s+$", "")


def text_layer(raw: Column | str, shown: int = 12_000) -> dict[str, Column]:
    """has_text, char_count, control_character_count, control_character_codes, text_sha256 and prompt_text."""
    raw = F.coalesce(col(raw), F.lit(""))
    clean, control = sanitize_text_layer(raw), F.regexp_extract_all(raw, F.lit("[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.lit(0))
    return {
        "has_text": clean != "",
        "char_count": F.length(clean),
        "control_character_count": F.size(control),
        "control_character_codes": F.array_sort(F.array_distinct(F.transform(control, F.ascii))),
        "text_sha256": F.when(clean != "", F.sha2(clean, 256)),
        "prompt_text": F.left(clean, F.lit(shown)),
    }


def _strip(c: Column, characters: str) -> Column:
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def slugify(c: Column | str, default: str = "pdf-bundle") -> Column:
    return F.coalesce(F.nullif(_strip(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "-"), "-"), F.lit("")), F.lit(default))


def safe_filename(c: Column | str, default: str = "lecture") -> Column:
    return F.coalesce(F.nullif(_strip(F.regexp_replace(col(c), r"(?U)[^\w .-]", "_"), " ."), F.lit("")), F.lit(default))


def sanitize_ext(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("bin"))


def markdown_image(alt: Column, path: Column) -> Column:
    escaped = F.regexp_replace(alt, r"([\\\[\]])", r"\\$1")
    return F.concat(F.lit("!["), escaped, F.lit("](<../"), path, F.lit(">)"))


def _attribute(placeholder: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(placeholder, f'(?<![a-z_]){name}="([^"]+)"', 1), F.lit(""))


def normalize_placeholders(c: Column | str) -> Column:
    """Older image placeholders to Markdown images, or to comments where no file is named."""
    text = col(c)

    def render(p: Column) -> Column:
        number = F.regexp_extract(p, r"IMAGE (\d{3})", 1)
        path, alt = F.coalesce(_attribute(p, "asset"), _attribute(p, "source")), F.coalesce(_attribute(p, "alt"), F.concat(F.lit("IMAGE "), number))
        return F.when(path.isNotNull(), markdown_image(alt, path)).otherwise(F.concat(F.lit("<!-- IMAGE "), number, F.lit(" -->")))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))
    return F.aggregate(found, text, lambda acc, p: F.replace(acc, p, render(p)))


def image_numbers(c: Column | str) -> Column:
    text = col(c)
    older = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), lambda p: F.regexp_extract(p, r"IMAGE (\d{3})", 1))
    return F.transform(F.concat(older, F.regexp_extract_all(text, F.lit(COMMENT), F.lit(1)), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))), lambda x: x.cast("int"))


def quick_add(c: Column | str) -> dict[str, Column]:
    """content, project, section, labels and priority of a captured line."""
    text = col(c)
    one = lambda mark: F.nullif(F.regexp_extract(text, rf"(?U)(?:^|\s){mark}([\w-]+)", 1), F.lit(""))
    labels = F.regexp_extract_all(text, F.lit(r"(?U)(?:^|\s)@([\w-]+)"), F.lit(1))
    priority = F.regexp_extract(text, r"(?:^|\s)p([1-4])(?=\s|$)", 1)
    content = F.regexp_replace(text, r"(?U)(?:^|(?<=\s))(?:[#/@][\w-]+|p[1-4](?=\s|$))", "")
    return {"content": F.trim(F.regexp_replace(content, r"(?U)\s+", " ")), "project": one("#"), "section": one("/"), "labels": labels, "priority": F.coalesce(priority.try_cast("int"), F.lit(4))}


def journal_document(name: Column, body: Column) -> Column:
    return F.concat(F.lit("---\ntitle: "), name, F.lit("\n---\n\n"), body, F.lit("\n"))


def parse_journal(c: Column | str) -> dict[str, Column]:
    return {"title": F.regexp_extract(col(c), r"^---\ntitle: ([^\n]*)\n---\n", 1), "body": F.regexp_extract(col(c), r"(?s)^---\n.*?\n---\n\n(.*)\n$", 1)}


def page_file(n: Column | str) -> Column:
    return F.format_string("page-%04d.json", col(n))


def image_file(page: Column | str, index: Column | str, ext: Column) -> Column:
    return F.format_string("page-%04d-image-%03d.%s", col(page), col(index), ext)


def media_type(c: Column | str) -> Column:
    return F.when(col(c) == "png", "image/png").when(col(c) == "jpeg", "image/jpeg")


def format_timestamp(c: Column | str) -> Column:
    """Seconds cut off: MM:SS, or H:MM:SS from an hour on."""
    n = col(c).cast("int")
    hours, minutes, seconds = F.floor(n / 3600).cast("int"), F.floor(n % 3600 / 60).cast("int"), n % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).otherwise(F.format_string("%02d:%02d", minutes, seconds))


def stamp(c: Column | str) -> Column:
    """Seconds rounded half to even, at least 0: HH:MM:SS."""
    n = F.greatest(F.bround(col(c), 0).cast("int"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(n / 3600).cast("int"), F.floor(n / 60).cast("int") % 60, n % 60)


def utc_iso(c: Column | str) -> Column:
    return F.date_format(F.date_trunc("second", col(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def round_bbox(c: Column | str) -> Column:
    return F.transform(col(c), lambda x: F.bround(x, 2))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def config_hash(*columns: str) -> Column:
    """Of the JSON of the columns in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
