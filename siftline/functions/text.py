"""Text preparation: cleaning, normalising, sentence and paragraph splitting."""

from __future__ import annotations

from siftline.functions.sql import let, prefix_sums, quote

# Characters that change the result of cleaning or splitting.
SENTENCE_ENDS = "。！？!?"
# the last two of the first string have no counterpart and are deleted
QUOTES_AND_BLANKS, PLAIN_QUOTES_AND_BLANKS = "\u3000“”‘’\u200b\ufeff", " \"\"''"
FOLDED_PUNCTUATION = "，。；：！？、（）【】《》「」『』“”‘’—…·"
WIDE_CHARS = "０１２３４５６７８９ＡＢＣ"
NARROW_CHARS = "0123456789ABC"
SEPARATOR = "\x01"  # removed by cleaning, so it cannot occur in a cleaned text
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: str) -> str:
    return f"trim(BOTH {quote(BLANKS)} FROM {text})"


def _by_script(text: str, plain: str, full: str) -> str:
    """Use a shorter expression for texts of ASCII only; character maps are slow."""
    return f"CASE WHEN octet_length({text}) = length({text}) THEN {plain} ELSE {full} END"


def clean_text(text: str) -> str:
    """Unify newlines, drop control and zero-width characters, plain quotes, squeeze blanks."""
    return _by_script(text, _clean(text, False), _clean(text, True))


def _clean(text: str, wide: bool) -> str:
    t = f"replace(replace(coalesce({text}, ''), '\r\n', '\n'), '\r', '\n')"
    t = f"regexp_replace({t}, {quote(r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')}, '')"
    t = f"regexp_replace({t}, {quote(r'\n{3,}')}, '\n\n')"
    if wide:
        t = f"translate({t}, {quote(QUOTES_AND_BLANKS)}, {quote(PLAIN_QUOTES_AND_BLANKS)})"
    t = f"regexp_replace({t}, {quote(r'[ \t]{2,}')}, ' ')"
    return strip(t)


def normalize_text(text: str, keep_newlines: bool = False, fold: tuple[str, str] | None = None) -> str:
    """Matching form of a text: cleaned, folded, lower case, punctuation as blanks.

    ``fold`` is a (from, to) pair of equally long strings for script folding;
    ``keep_newlines`` keeps line and paragraph breaks for window splitting.
    """
    full = _normalize(text, keep_newlines, fold, True)
    return full if fold else _by_script(text, _normalize(text, keep_newlines, None, False), full)


def _normalize(text: str, keep_newlines: bool, fold: tuple[str, str] | None, wide: bool) -> str:
    t = _clean(text, wide)
    if fold:
        t = f"translate({t}, {quote(fold[0])}, {quote(fold[1])})"
    t = f"lower({t})"
    if wide:
        # a character map is several times faster than a regex class of wide characters
        t = f"translate({t}, {quote(FOLDED_PUNCTUATION + WIDE_CHARS)}, {quote(' ' * len(FOLDED_PUNCTUATION) + NARROW_CHARS)})"
    if keep_newlines:
        t = f"regexp_replace({t}, {quote(r'[ \t]{2,}|\t')}, ' ')"
    else:
        t = f"regexp_replace({t}, {quote('[' + BLANKS + ']+')}, ' ')"
    return strip(t)


def _marked(text: str, ends: str) -> str:
    """Text with a separator after every end mark."""
    for end in ends:
        text = f"replace({text}, {quote(end)}, {quote(end + SEPARATOR)})"
    return text


def _lone(piece: str, ends: str) -> str:
    """A piece that is nothing but one end mark belongs to no sentence."""
    return f"{piece} IN ({', '.join(quote(e) for e in ends)})"


def sentence_texts(text: str, ends: str = SENTENCE_ENDS) -> str:
    """array<string> of trimmed, non-blank sentences; line breaks always split."""
    # marks become line breaks by plain replacement, which beats a regex over wide characters
    pieces = f"split(replace({_marked(text, ends)}, {quote(SEPARATOR)}, '\n'), '\n', -1)"
    return f"filter(transform({pieces}, _s -> CASE WHEN {_lone('_s', ends)} THEN '' ELSE {strip('_s')} END), _s -> _s <> '')"


def sentences(text: str, ends: str = SENTENCE_ENDS) -> str:
    """array<struct<start,end,text>> of sentences with character offsets."""
    pieces = (
        f"flatten(transform(split({_marked(text, ends)}, '\n', -1), _l -> {let('_q', f'split(_l, {quote(SEPARATOR)}, -1)', '{body}')}))"
    ).format(body="transform(_q, (_s, _j) -> named_struct('s', _s, 'n', length(_s) + CASE WHEN _j = size(_q) - 1 THEN 1 ELSE 0 END))")
    spans = (
        "transform(_p, (_s, _i) -> named_struct('start', element_at(_o, _i + 1),"
        f" 'end', element_at(_o, _i + 1) + length(_s.s), 'text', CASE WHEN {_lone('_s.s', ends)} THEN '' ELSE {strip('_s.s')} END))"
    )
    body = let("_o", prefix_sums("transform(_p, _x -> _x.n)"), spans)
    return f"filter({let('_p', pieces, body)}, _w -> _w.text <> '')"


def paragraph_texts(text: str) -> str:
    """array<string> of trimmed, non-blank paragraphs (blank lines separate them)."""
    return f"filter(transform(split({text}, {quote(r'\n\s*\n')}), _s -> {strip('_s')}), _s -> _s <> '')"


def paragraphs(text: str) -> str:
    """array<struct<start,end,text>> of paragraphs; the separators are not part of them."""
    seps = f"regexp_extract_all({text}, {quote(r'\n\s*\n')}, 0)"
    parts = f"split({text}, {quote(r'\n\s*\n')})"
    lens = "transform(_p, (_s, _i) -> length(_s) + coalesce(length(try_element_at(_q, _i + 1)), 0))"
    spans = (
        "transform(_p, (_s, _i) -> struct(element_at(_o, _i + 1) AS start,"
        f" element_at(_o, _i + 1) + length(_s) AS end, {strip('_s')} AS text))"
    )
    body = let("_q", seps, let("_o", prefix_sums(lens), spans))
    return f"filter({let('_p', parts, body)}, _w -> _w.text <> '')"


def triples(texts: str, joiner: str = "\n") -> str:
    """array<string>: each sentence joined with the next two."""
    return let(
        "_s3",
        texts,
        "transform(_s3, (_x, _i) -> array_join(slice(_s3, _i + 1, 3), " + quote(joiner) + "))",
    )


def count_occurrences(text: str, term: str) -> str:
    """Number of non-overlapping occurrences."""
    return f"cast((length({text}) - length(replace({text}, {term}, ''))) DIV length({term}) AS int)"


def find_occurrences(text: str, term: str) -> str:
    """array<struct<start,end>> of all non-overlapping occurrences in a cleaned text (0-based offsets)."""
    parts = f"split(replace({text}, {term}, {quote(SEPARATOR)}), {quote(SEPARATOR)}, -1)"
    spans = (
        "transform(slice(_o, 2, size(_o) - 2), (_x, _i) -> struct("
        f"_x + _i * length({term}) AS start, _x + (_i + 1) * length({term}) AS end))"
    )
    return let("_o", prefix_sums(f"transform({parts}, _y -> length(_y))"), spans)


def regex_spans(text: str, regex: str, body: str) -> str:
    """``body`` over ``_m``: array<struct<start,end,raw>> of the matches of a regex.

    Offsets come from the lengths of the matches and of the gaps between
    them, so two passes of the regex are enough.  The gaps are cut at a
    separator put in place of the matches: ``split`` would compile the regex
    anew for every row.
    """
    rx = quote(regex)
    text = f"replace({text}, {quote(SEPARATOR)}, ' ')"
    gaps = f"split(regexp_replace({text}, {rx}, {quote(SEPARATOR)}), {quote(SEPARATOR)}, -1)"
    spans = (
        "transform(_h, (_r, _i) -> named_struct('start', element_at(_o, _i + 1) + element_at(_g, _i + 1),"
        " 'end', element_at(_o, _i + 1) + element_at(_g, _i + 1) + length(_r), 'raw', _r))"
    )
    pairs = "zip_with(slice(_g, 1, size(_h)), _h, (_a, _b) -> _a + length(_b))"
    found = let("_o", prefix_sums(pairs), spans)
    found = let("_g", f"transform({gaps}, _y -> length(_y))", found)
    found = let("_h", f"regexp_extract_all({text}, {rx}, 0)", found)
    return let("_m", found, body)


def snippet(text: str, term: str, radius: int = 25) -> str:
    """Text around the first occurrence, marked with an ellipsis on both sides."""
    start = f"greatest(locate({term}, {text}) - {radius}, 1)"
    stop = f"locate({term}, {text}) + length({term}) + {radius}"
    cut = f"substring({text}, {start}, {stop} - {start})"
    return f"concat('…', regexp_replace({cut}, '^…+|…+$', ''), '…')"


def fit(text: str, limit: int = 220) -> str:
    """Remove all white space and cut to ``limit`` characters, marking the cut."""
    squeezed = f"translate({text}, {quote(BLANKS)}, '')"
    return let(
        "_f",
        squeezed,
        f"CASE WHEN length(_f) > {limit} THEN concat(substring(_f, 1, {limit - 3}), '…') ELSE _f END",
    )
