"""Text and path expressions that stay inside the JVM (inventory P1, P2, P6-P8, P10, S15, F1-F14, F17)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def squashed(c: Column) -> Column:
    """Lower-case letters, marks and digits only; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, "")


def spaced(c: Column) -> Column:
    """Lower-case words parted by single blanks; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, " "))


def same_file(c: Column) -> Column:
    """One form for all spellings of a relative path: case, slashes and ./ aside; null and blank give ''."""
    p = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\\/]+", "/")
    return F.regexp_replace(p, r"(^|/)(\./)+", "$1")


def md5_key(*cols: Column) -> Column:
    """16 bytes over the columns, with a separator that none of them holds."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *cols)))


def stripped(c: Column) -> Column:
    """White space of any script cut from both ends; null gives ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def composed(title: Column, body: Column, limit: int = 300) -> Column:
    """'title. body', the body cut to ``limit`` code points; what is blank is left out with its stop."""
    blank = lambda c: F.nullif(stripped(c), F.lit(""))
    return F.concat_ws(". ", blank(title), F.nullif(F.left(stripped(body), F.lit(limit)), F.lit("")))


def words(c: Column) -> Column:
    """Number of words parted by white space; null and blank have none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def junk(title: Column, text: Column) -> Column:
    """Pages that are lists, disambiguations or shorter than 20 characters. Null titles and texts count as ''."""
    t = F.coalesce(title, F.lit(""))
    return F.startswith(t, F.lit("List of")) | F.contains(t, F.lit("(disambiguation)")) | (F.length(stripped(text)) < 20)


def plain(c: Column) -> Column:
    """Lower case, everything but letters, digits, marks and '_' as a blank, blanks collapsed (Unicode classes). Null gives ''."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def unquoted(c: Column) -> Column:
    """Percent-decoded with '+' kept and underscores as blanks; what can't be decoded stays."""
    return F.replace(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c), F.lit("_"), F.lit(" "))


def jpg_name(path: Column) -> Column:
    """File name before its first dot, with .jpg."""
    return F.concat(F.split(F.element_at(F.split(path, "/"), -1), "[.]")[0], F.lit(".jpg"))


def human(n: Column) -> Column:
    """Bytes with a unit and two decimals."""
    out = F.format_string("%.2f B", n.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(out)
    return out


def full_normal(c: Column) -> Column:
    """HTML escapes resolved, NFKC, then ``plain``: the first two have no expression, so texts pass a pandas UDF."""
    @F.pandas_udf("string")
    def resolve(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))

    return plain(resolve(c))


def pictured_page(title: Column, kind: Column, description: Column, image: Column) -> Column:
    """Pages worth keeping: a title that is no list, no disambiguation by kind or description, and a jpg, jpeg or png. Nulls count as ''."""
    text = lambda c: F.coalesce(c, F.lit(""))
    unclear = (text(kind) == "disambiguation") | F.contains(F.lower(text(description)), F.lit("disambiguation"))
    picture = F.lower(text(image)).rlike(r"\.(jpg|jpeg|png)$")
    return (text(title) != "") & ~F.startswith(text(title), F.lit("List of")) & ~unclear & picture


def resolved(path: Column, root: str, fallback: str) -> Column:
    """An absolute path as it is, others below ``root``, or below ``fallback`` where no root is given; '.', '..' and repeated slashes resolved."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(f"{root or fallback}/"), path))

    def step(stack: Column, part: Column) -> Column:
        up = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(part.isin("", "."), stack).when(part == "..", up).otherwise(F.concat(stack, F.array(part)))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def file_name(title: Column, url: Column) -> Column:
    """A name for a title's file: blanks and slashes as underscores, with the extension of the url's last part, if any."""
    return F.concat(F.translate(title, " /", "__"), F.regexp_extract(url, r"[^/.][^/]*?(\.[^./]*)$", 1))


def page_id(url: Column, number: Column) -> Column:
    """What follows the last /wiki/ of an address, else UNK_ and a number."""
    return F.when(F.contains(url, F.lit("/wiki/")), F.element_at(F.split(url, "/wiki/"), -1)).otherwise(F.concat(F.lit("UNK_"), number.cast("string")))


def percent(share: Column) -> Column:
    """A share with two decimals and a percent sign."""
    return F.format_string("%.2f%%", 100.0 * share)


def run_label(mode: Column, chunk: Column, entity_tile: Column, matcher_tile: Column) -> Column:
    """mode_chunk_N, with the sizes of tiles that are above 0."""
    tile = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name}_"), n.cast("string")))
    return F.concat_ws("_", mode, F.lit("chunk"), chunk.cast("string"), tile("entity_tile", entity_tile), tile("tglu_tile", matcher_tile))


def binary_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal, '?' for null."""
    x = n.cast("double")
    out = F.format_string("%.1f PiB", x / float(1024**5))
    for power, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB", "TiB")))):
        out = F.when(F.abs(x) < float(1024 ** (power + 1)), F.format_string(f"%.1f {unit}", x / float(1024**power))).otherwise(out)
    return F.coalesce(F.when(x.isNotNull(), out), F.lit("?"))


def joined_key(*parts: Column) -> Column:
    """MD5 of the parts joined by underscores; null parts are left out."""
    return F.md5(F.concat_ws("_", *(p.cast("string") for p in parts)))


def sorted_key(**fields: Column) -> Column:
    """MD5 of the fields as JSON in the order of their names, nulls kept, so how they were listed makes no difference."""
    return F.md5(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}))


def first_of(values: Column, default: str = "") -> Column:
    """First element of a list, the default where it is null, empty or starts with null."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def chosen_image(images: Column, key: Column, seed: int | None = None) -> Column:
    """The first image of a list, or with a seed one picked by the row's key; null for null and empty lists."""
    n = F.size(images)
    at = F.lit(1) if seed is None else (F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint"), n) + 1).cast("int")
    return F.when(n > 0, F.get(images, at - 1))
