"""HTML as one marked-up string: tags, attributes, elements, text.

``markup`` reads a page once, in linear time, by a pattern whose loops never give back what they took:
they neither backtrack nor nest calls, however long a page is. Every tag becomes OPEN name ATTRS its
inside RAW END, where a script or style element is one tag whose content stands between RAW and END.
Comments, declarations and the like become tags without a name. Quotes, ``>`` in values, comments and
scripts are settled by that, so everything else works on plain delimiters. ``decoded`` then resolves the
character references of the whole page at once; only ``scripts`` takes the string before that.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorgrid.functions import text

# Control characters that stand in no text.
OPEN, ATTRS, END, RAW = "\x01", "\x02", "\x03", "\x04"
# They stand for quotes that came from references, which end no value.
_QUOTES = "\x05\x06"
# Values are quoted only after "="; what is never closed ends with the page.
_INSIDE = r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+)"""
_TOKEN = (
    rf"(?is)<(script|style)(?=[\s/>]){_INSIDE}(?:>(.*?)(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"
    r"|<!--(?:-?>|.*?--!?>|.*+)"
    rf"|<(/?[a-z][^\s/>]*+){_INSIDE}(?:>|\z)"
    r"|<[!?/][^>]*+(?:>|\z)")
_TAG = f"{OPEN}[^{END}]*+{END}"


def markup(html: Column) -> Column:
    """The marked-up string of a page."""
    plain = F.regexp_replace(html, f"[{OPEN}-{_QUOTES[-1]}]++", "")
    return F.regexp_replace(plain, _TOKEN, f"{OPEN}$1$4{ATTRS}$2$5{RAW}$3{END}")


# Named references of HTML 4 from the standard library; a no-break space counts as a space here.
_NAMED = json.dumps({
    **{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'", "nbsp": " "})
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"


def _character(name: Column) -> Column:
    """Character of a reference (without & and ;), null if there is none."""
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
        F.substr(name, F.lit(2))).cast("int")
    valid = code.between(9, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name)
    return F.when(name.startswith("#"), numbered).otherwise(named)


def unescape(col: Column, quotes: str = "\"'") -> Column:
    """Decode character references once, named and numbered; unknown ones stay as they are.

    Decoded quotes become the two characters of ``quotes``.
    """
    def piece(rest: Column) -> Column:
        return text.let(F.regexp_extract(rest, _REFERENCE, 1), lambda name: F.coalesce(
            F.concat(F.translate(_character(name), "\"'", quotes), F.substr(rest, F.length(name) + 2)),
            F.concat(F.lit("&"), rest)))

    def joined(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(
            F.slice(parts, F.lit(2), F.size(parts)), piece), ""))

    return text.let(col, lambda c: F.when(
        c.contains("&"), text.let(F.split(c, "&"), joined)).otherwise(c))


def decoded(marked: Column) -> Column:
    """The marked-up string with its references decoded and without the contents of scripts."""
    return unescape(F.regexp_replace(marked, f"{RAW}[^{END}]++{END}", RAW + END), _QUOTES)


def _plain(col: Column) -> Column:
    """With real quotes for those that stood for references."""
    return F.translate(col, _QUOTES, "\"'")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the inside of a tag, null when absent or blank."""
    # The other attributes are stepped over whole: a value that reads like one is none.
    pattern = (rf"""(?is)^(?:[\s/]*+(?!{name}[\s=])[^\s=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)?+)?+)*+"""
               rf"""[\s/]*+{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"']\S*+)""")

    def unquoted(raw: Column) -> Column:
        bare = F.when(raw.startswith('"'), F.btrim(raw, F.lit('"'))).otherwise(
            F.btrim(raw, F.lit("'")))
        return text.non_blank(_plain(bare))

    return text.let(F.regexp_extract(tag, pattern, 1), unquoted)


def has_class(tag: Column, name: str) -> Column:
    """Whether the class attribute holds a name (a regex)."""
    return F.coalesce(attribute(tag, "class"), F.lit("")).rlike(rf"(^|\s)(?:{name})(\s|$)")


def inner_text(marked: Column, sep: str = " ") -> Column:
    """Text without tags: pieces stripped, empty ones dropped, joined by ``sep``."""
    pieces = F.transform(F.split(marked, _TAG), text.strip)
    return _plain(F.array_join(F.filter(pieces, lambda p: p != ""), sep))


def tags(marked: Column, names: str) -> Column:
    """Insides of the opening tags of the given names (a regex alternation), in page order."""
    return F.regexp_extract_all(
        marked, F.lit(f"(?i){OPEN}(?:{names}){ATTRS}([^{RAW}]*+){RAW}"), F.lit(1))


def anchors(marked: Column) -> Column:
    """array of struct(attrs, body) of the page's links that have an href. A link ends where the next
    one begins at the latest."""
    pattern = F.lit(f"(?i){OPEN}a{ATTRS}([^{RAW}]*+){RAW}{END}"
                    f"((?:[^{OPEN}]++|{OPEN}(?!/?a{ATTRS}))*+)")
    both = F.arrays_zip(
        F.regexp_extract_all(marked, pattern, F.lit(1)).alias("attrs"),
        F.regexp_extract_all(marked, pattern, F.lit(2)).alias("body"))
    return F.filter(both, lambda a: attribute(a["attrs"], "href").isNotNull())


def scripts(marked: Column, test: Callable[[Column], Column]) -> Column:
    """Contents of the script elements whose attributes pass ``test``; of a string not yet decoded."""
    pattern = F.lit(f"(?i){OPEN}script{ATTRS}([^{RAW}]*+){RAW}([^{END}]*+){END}")
    both = F.arrays_zip(
        F.regexp_extract_all(marked, pattern, F.lit(1)).alias("attrs"),
        F.regexp_extract_all(marked, pattern, F.lit(2)).alias("body"))
    return F.transform(F.filter(both, lambda s: F.coalesce(test(s["attrs"]), F.lit(False))),
                       lambda s: s["body"])


def _inside_of(piece: Column) -> Column:
    return F.substring_index(F.substring_index(piece, RAW, 1), ATTRS, -1)


def _marks(pieces: Column, names: str, test: Callable[[Column, Column], Column]) -> Column:
    """The pieces that open or close ``names``: their place, step (1, -1) and whether ``test`` (piece,
    inside of the tag) holds."""
    named = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    wanted = F.filter(named, lambda m: m["p"].rlike(f"(?i)^/?(?:{names}){ATTRS}"))
    return F.transform(wanted, lambda m: F.struct(
        m["i"], F.when(m["p"].startswith("/"), -1).otherwise(1).alias("step"),
        (~m["p"].startswith("/") & F.coalesce(
            test(m["p"], _inside_of(m["p"])), F.lit(False))).alias("hit")))


def element(marked: Column, name: str, test: Callable[[Column], Column]) -> Column:
    """Inside of the first element of a name whose attributes pass ``test``, with elements of the same
    name in it to any depth; null if there is none. One that is not closed goes on to the end."""
    def step(s: Column, m: Column) -> Column:
        depth = s["depth"] + m["step"]
        begun = F.when(m["hit"], F.struct(
            m["i"].alias("start"), F.lit(1).alias("depth"), s["end"])).otherwise(s)
        going = F.struct(s["start"], depth.alias("depth"), F.when(
            depth == 0, m["i"]).otherwise(s["end"]).alias("end"))
        return F.when(s["end"] >= 0, s).when(s["start"] < 0, begun).otherwise(going)

    def cut(pieces: Column) -> Column:
        none = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("depth"), F.lit(-1).alias("end"))
        return text.let(
            F.aggregate(_marks(pieces, name, lambda _, inside: test(inside)), none, step),
            lambda s: F.when(s["start"] >= 0, F.concat(
                F.substring_index(F.get(pieces, s["start"]), END, -1),
                F.array_join(F.transform(F.slice(
                    pieces, s["start"] + 2,
                    F.when(s["end"] >= 0, s["end"] - s["start"] - 1).otherwise(F.size(pieces))),
                    lambda p: F.concat(F.lit(OPEN), p)), ""))))

    return text.let(F.split(marked, OPEN), cut)


def tags_within(marked: Column, box: str, test: Callable[[Column], Column], inner: str) -> Column:
    """Insides of the ``inner`` tags that stand in any ``box`` element whose attributes pass ``test``,
    however deep; one that is not closed goes on to the end."""
    def step(s: Column, m: Column) -> Column:
        within = s["depth"] > 0
        taken = F.when(within, F.array_append(s["found"], m["inside"])).otherwise(s["found"])
        return F.when(m["inside"].isNotNull(), F.struct(s["depth"], taken.alias("found"))).otherwise(
            F.struct(F.when(within, s["depth"] + m["step"]).when(m["hit"], 1).otherwise(0).alias(
                "depth"), s["found"]))

    def cut(pieces: Column) -> Column:
        marks = F.transform(
            _marks(pieces, f"{box}|{inner}", lambda p, inside: p.rlike(f"(?i)^{box}{ATTRS}") & test(inside)),
            lambda m: text.let(F.get(pieces, m["i"]), lambda p: F.struct(
                m["step"], m["hit"], F.when(
                    p.rlike(f"(?i)^{inner}{ATTRS}"), _inside_of(p)).alias("inside"))))
        none = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("found"))
        return F.aggregate(marks, none, step)["found"]

    return text.let(F.split(marked, OPEN), cut)


def sections(marked: Column, name: str, cls: str) -> Column:
    """Insides of all elements of a name and class that end with the next tag of that name."""
    pattern = (f"(?i){OPEN}{name}{ATTRS}([^{RAW}]*+){RAW}{END}"
               f"((?:[^{OPEN}]++|{OPEN}(?!/?{name}{ATTRS}))*+)")
    both = F.arrays_zip(
        F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)).alias("attrs"),
        F.regexp_extract_all(marked, F.lit(pattern), F.lit(2)).alias("body"))
    return F.transform(F.filter(both, lambda e: has_class(e["attrs"], cls)), lambda e: e["body"])
