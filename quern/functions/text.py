"""Text functions as Column expressions: tokenizers, splitters, estimates, trims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.columns import let

#: Ranges of CJK ideographs.
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}"
#: White space as two languages' trim functions define it.
_SHARED_SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
GO_SPACE = _SHARED_SPACE + "\x85"
JS_SPACE = _SHARED_SPACE + "\ufeff"
#: How a follow-up question starts (no word boundary is asked for).
FOLLOW_UP_PREFIXES = (
    "that", "this", "it", "those", "these", "they", "he", "she", "其", "这个", "那个", "这些", "那些", "它", "它们",
    "继续", "再", "顺便", "continue", "also", "and",
)
#: Words that say nothing about what a question is about.
STOP_WORDS = (
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "is", "are", "was", "were", "do", "does",
    "did", "can", "could", "will", "would", "shall", "should", "may", "might", "the", "a", "an", "in", "on", "at", "to",
    "for", "of", "with", "by", "from", "and", "or", "but", "not", "this", "that", "these", "those", "it", "its", "be",
    "been", "being", "have", "has", "had", "请", "怎么", "如何", "什么", "为什么", "哪里", "哪个", "多少", "吗", "呢",
    "吧", "的", "了", "在", "是", "有", "和", "与", "或", "不", "也", "都", "就", "要", "会", "能", "可以", "应该",
    "需要", "必须", "已经", "还", "更", "最",
)


def unicode_trim(text: Column) -> Column:
    """Trim every Unicode white space (also U+0085 and U+00A0)."""
    return F.trim(text, F.lit(GO_SPACE))


def script_trim(text: Column) -> Column:
    """Trim space separators, line ends and the byte-order mark, but not U+0085."""
    return F.trim(text, F.lit(JS_SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(unicode_trim(text), F.lit("")) == ""


def non_blank(text: Column, default: Column) -> Column:
    """The text, or the default where it is null or blank."""
    return F.when(is_blank(text), default).otherwise(text)


def normalize_space(text: Column) -> Column:
    return script_trim(F.regexp_replace(text, f"[{JS_SPACE}]+", " "))


def tokenize_terms(text: Column) -> Column:
    """The distinct search terms of a text.

    Lower-cased and trimmed; a run of ideographs gives its characters, its pairs and, from
    three on, itself; any other run of letters and digits of two bytes or more is a term
    (such a run takes ideographs that follow directly with it). The order is that of first
    appearance. Null gives an empty array.
    """
    none = F.array().cast("array<string>")
    word = r"[\p{L}\p{Nd}]+"

    def pieces(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        places = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        pairs = F.when(n > 1, F.transform(places, lambda i: F.substring(run, i, F.lit(2)))).otherwise(none)
        whole = F.when(n >= 3, F.array(run)).otherwise(none)
        own = F.when(F.octet_length(run) >= 2, F.array(run)).otherwise(none)
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(singles, pairs, whole)).otherwise(own)

    def terms(lowered: Column) -> Column:
        plain = F.filter(F.regexp_extract_all(lowered, F.lit(f"({word})"), F.lit(1)), lambda t: F.octet_length(t) >= 2)
        # a repeated run gives nothing new
        runs = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"([{CJK}]+|{word})"), F.lit(1)))
        mixed = F.flatten(F.transform(runs, pieces))
        return F.when(lowered.rlike(f"[{CJK}]"), mixed).otherwise(plain)

    return F.array_distinct(let(F.lower(F.coalesce(text, F.lit(""))), terms))


def extract_terms(text: Column) -> Column:
    """Terms of the local corpus search: runs of ASCII letters, digits and ideographs of
    two characters or more; repeats are kept."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{4e00}-\x{9fa5}]+")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def eval_terms(text: Column) -> Column:
    """Distinct ASCII terms of two characters or more, as the evaluation retrieves them."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def keywords(text: Column) -> Column:
    """Distinct words of a question without its stop words.

    Word boundaries are those of ASCII word characters, so ideographs that stand alone are
    not removed unless ASCII word characters touch them on the outside of the boundary.
    """
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    listed = f"{edge}(?:{'|'.join(STOP_WORDS)}){edge}"

    def parts(run: Column) -> Column:
        return F.split(F.regexp_replace(run, listed, " "), r"[^a-z0-9\x{4e00}-\x{9fff}]+")

    # a stop word lies within a run, and in a run of ASCII letters and digits it is the whole run, so
    # such runs need only be looked up; the distinct others are few
    runs = F.split(F.lower(text), r"[^a-z0-9_\x{4e00}-\x{9fff}]+")
    told = F.array_except(runs, F.array(*(F.lit(w) for w in STOP_WORDS if w.isascii())))
    mixed = r"[_\x{4e00}-\x{9fff}]"

    def words(found: Column) -> Column:
        cut = F.flatten(F.transform(found, lambda r: F.when(r.rlike(mixed), parts(r)).otherwise(F.array(r))))
        return F.when(F.exists(found, lambda r: r.rlike(mixed)), F.array_distinct(cut)).otherwise(found)

    return F.filter(let(told, words), lambda w: F.length(w) >= 2)


def token_units(text: Column) -> tuple[Column, Column]:
    """What the estimate is made of: ideographs, and other UTF-16 units above the space (characters
    beyond the basic plane are two). Both add up over texts."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    other = F.length(F.regexp_replace(text, rf"[{CJK}\x00-\x20]", ""))
    pairs = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10ffff}]", ""))
    return cjk, other + pairs


def estimate_tokens(text: Column) -> Column:
    """Half a token per ideograph, a quarter per other UTF-16 unit above the space, rounded
    up; characters beyond the basic plane are two units."""
    cjk, units = token_units(text)
    return F.ceil(cjk / 2 + units / 4).cast("long")


def sub_queries(text: Column, most: int = 3) -> Column:
    """The first parts of a question that question marks, line ends, "and", "also" part."""
    parts = F.split(text, r"[?\x{ff1f}!\x{ff01};\x{ff1b}\n]+|(?i:\s+and\s+)|(?i:\s+also\s+)")
    return F.slice(F.filter(F.transform(parts, normalize_space), lambda p: p != ""), 1, most)


def looks_like_follow_up(text: Column) -> Column:
    prefixes = F.array(*map(F.lit, FOLLOW_UP_PREFIXES))
    return let(F.lower(script_trim(text)), lambda lowered: F.exists(prefixes, lambda p: F.startswith(lowered, p)))


def sentences(text: Column) -> Column:
    """``array<struct<text, start, stop>>`` of sentences, ended by ideographic marks or a
    line end; texts are trimmed, byte places are those of the untrimmed sentence."""
    parts = F.regexp_extract_all(text, F.lit("([^。！？\n]*[。！？\n]|[^。！？\n]+)"), F.lit(1))
    # one pass: (bytes so far, sentences so far)
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,stop:int>>").alias("out")
    )

    def step(state: Column, part: Column) -> Column:
        stop = state["at"] + F.octet_length(part)
        one = F.array(F.struct(unicode_trim(part).alias("text"), state["at"].alias("start"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"), F.when(is_blank(part), state["out"]).otherwise(F.concat(state["out"], one)).alias("out")
        )

    return F.aggregate(parts, start, step, lambda s: s["out"])


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
