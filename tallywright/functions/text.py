"""Text columns: stripping, measuring, cutting, chunking, prompts, responses.

Every function takes a column (or its name) and returns a column made of
Spark built-ins, so it stays inside the JVM and inside one stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters Python's str.split() and str.strip() treat as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
FENCE = "```"
FENCE_TAG = "python"
PREVIEW_CHARS = 1000
INPUT_CHARS = 4000
INSIGHT_CHARS = 1000
CHUNK_WIDTH = 300
CHUNK_OVERLAP = 50
SUMMARY_WORDS = {
    "Short (500 words)": 500,
    "Medium (800 words)": 800,
    "Long (2000 words)": 2000,
}
SUMMARY_WORDS_OTHERWISE = 2000
SUMMARY_WORDS_DEFAULT = 150
SUMMARY_PROMPT = (
    "You are a professional summarizer. Summarize the following text concisely "
    "in approximately {words} words. Focus on key points and main ideas.\n"
    "\n"
    "TEXT TO SUMMARIZE:\n"
    "{text}\n"
    "\n"
    "SUMMARY:"
)
INSIGHT_PROMPT = (
    "\n"
    "Based on this document summary, provide {type} analysis with key takeaways:\n"
    "\n"
    "Summary:\n"
    "{text}\n"
    "\n"
    "Provide 3-5 key points in {type} format.\n"
)
# --- end of fixed values ----------------------------------------------------


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def fill(template: str, **fields: Column) -> Column:
    """Concatenate a template's fixed parts with columns for its {fields}.

    A missing field leaves its place empty rather than making all of it missing.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        fixed, opened, rest = rest.partition("{")
        if fixed:
            parts.append(F.lit(fixed))
        if opened:
            name, _, rest = rest.partition("}")
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def strip(text: Column | str) -> Column:
    """Drop white space at both ends (Spark's own trim drops only blanks)."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


# Both classes name the printable ASCII characters first: the engine then settles
# the usual character with one comparison.
_SPACE_CLASS = "".join(rf"\x{{{ord(c):x}}}" for c in WHITE_SPACE)
_WORD = rf"[[!-~][^{_SPACE_CLASS}]]++"
_GAP = rf"[[^!-~]&&[{_SPACE_CLASS}]]++"


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(_WORD))


def char_count(text: Column | str) -> Column:
    return F.length(_col(text))


def lead_words(text: Column | str, count: Column | int) -> Column:
    """The first ``count`` words, joined by single blanks."""
    size = count if isinstance(count, Column) else F.lit(count)
    # leading white space takes up one piece; the text behind stays uncut
    pieces = F.split(_col(text), F.lit(_GAP), size + 2)
    words = F.filter(pieces, lambda piece: piece != "")
    return F.array_join(F.slice(words, F.lit(1), size), " ")


def truncate(text: Column | str, chars: int | None = INPUT_CHARS) -> Column:
    """The first ``chars`` characters; all of them for None."""
    return _col(text) if chars is None else F.substring(_col(text), 1, chars)


def preview(text: Column | str, chars: int = PREVIEW_CHARS) -> Column:
    text = _col(text)
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def summary_budget(label: Column | str) -> Column:
    """Words asked for by a length label; an unknown label asks for the most."""
    budget = F.lit(SUMMARY_WORDS_OTHERWISE)
    for name, words in SUMMARY_WORDS.items():
        budget = F.when(_col(label) == name, F.lit(words)).otherwise(budget)
    return budget


def summary_prompt(
    text: Column | str,
    words: Column | int = SUMMARY_WORDS_DEFAULT,
    chars: int | None = INPUT_CHARS,
) -> Column:
    words = words if isinstance(words, Column) else F.lit(words)
    return fill(SUMMARY_PROMPT, words=words, text=truncate(text, chars))


def insight_prompt(
    summary: Column | str,
    report_type: Column | str,
    chars: int | None = INSIGHT_CHARS,
) -> Column:
    kind = F.lit(report_type) if isinstance(report_type, str) else report_type
    return fill(INSIGHT_PROMPT, type=kind, text=truncate(summary, chars))


def clean_response(response: Column | str) -> Column:
    """Strip a model response and unwrap its first fenced block, if it has one."""
    response = strip(response)
    fenced = F.split_part(response, F.lit(FENCE), F.lit(2))
    bare = strip(fenced)
    untagged = F.when(
        F.startswith(bare, F.lit(FENCE_TAG)),
        strip(F.substring(bare, F.lit(len(FENCE_TAG) + 1), F.length(bare))),
    ).otherwise(bare)
    return F.when(F.contains(response, F.lit(FENCE)), untagged).otherwise(response)


def chunks(
    text: Column | str, width: int = CHUNK_WIDTH, overlap: int = CHUNK_OVERLAP
) -> Column:
    """Array of slices ``width`` wide whose starts lie ``width - overlap`` apart.

    One regex walk: each match consumes a stride and looks ahead over the
    slice, so the work is linear in the text. Cutting every slice with
    substring would re-read the text from its start each time.
    """
    stride = width - overlap
    if stride < 1:
        raise ValueError("overlap must be smaller than width")
    pattern = rf"(?s)(?=(.{{1,{width}}})).{{1,{stride}}}"
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))


def escape_html(text: Column | str) -> Column:
    escaped = F.replace(_col(text), F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))


def fixed(number: Column | str, places: int) -> Column:
    """Number text with a fixed count of decimals, as Python's ``.2f`` gives it.

    format_number rounds the exact binary value half to even, like Python;
    ``round`` would go half up. A missing number reads ``nan``.
    """
    plain = F.replace(F.format_number(_col(number), places), F.lit(","), F.lit(""))
    return F.coalesce(plain, F.lit("nan"))


def thousands(number: Column | str) -> Column:
    return F.format_number(_col(number), 0)
