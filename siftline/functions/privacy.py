"""Finding, masking and replacing personal data and secrets as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

from siftline.functions.sql import let, prefix_max, quote, string_array
from siftline.functions.text import SEPARATOR, regex_spans


@dataclass(frozen=True)
class Sensitive:
    """One kind of sensitive text.

    ``hints`` are lower-case strings of which at least one must be present,
    whatever the case of the text; ``needs`` is a kind of character that must
    be.  They keep the regex away from the many texts that cannot match.
    """

    kind: str
    regex: str
    replacement: str
    priority: int
    hints: tuple[str, ...] = ()
    needs: str = ""


# What a text must hold for a pattern to be tried.
NEEDS = {"cjk": r"[\u4e00-\u9fff]", "digit": r"\d"}
# Kinds, patterns, replacements and priorities (lower wins).
FAMILY_NAMES = (
    "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁"
    "于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎"
    "薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚"
)
SENSITIVE = (
    Sensitive("PRIVATE_CANARY", r"(?i)\b(?:RAW|ATTACHMENT)_PRIVATE_CANARY_[A-Z0-9]+\b", "[REDACTED_CANARY]", -2, ("canary",)),
    Sensitive("CN_NAME_OO", r"[\u4e00-\u9fff]{1,2}○○", "[REDACTED_PERSON]", -1, ("○○",)),
    Sensitive(
        "CN_NAME_CONTEXT",
        r"(?:姓名|名字|當事人|当事人|證人|证人|爆料人|來源|来源|聯絡人|联系人|署名|化名|source|witness)"
        r"[：:\s]*([\u4e00-\u9fff]{2,4})",
        "[REDACTED_PERSON]", 0, needs="cjk",
    ),
    Sensitive(
        "CN_NAME_HONORIFIC",
        r"[\u4e00-\u9fff]{1,2}(?:先生|小姐|女士|太太|主任|董事|經理|经理|里長|里长|議員|议员|"
        r"同學|同学|醫師|医师|律師|律师)",
        "[REDACTED_PERSON]", 1, needs="cjk",
    ),
    Sensitive(
        "CN_NAME_VERB",
        rf"(?:[{FAMILY_NAMES}])[\u4e00-\u9fff]{{1,3}}"
        r"(?=(?:昨天|今天|日前|表示|指出|告訴|告诉|說|说|提供|通過|通过|透過|透过|聯繫|联系|核實|核实|核驗|核验|爆料|證實|证实))",
        "[REDACTED_PERSON]", 2, needs="cjk",
    ),
    Sensitive(
        "CN_NAME_CONTACT",
        rf"(?:联系|聯繫|建議聯繫|建议联系|請聯繫|请联系|找|跟|問|问)(?:[{FAMILY_NAMES}])[\u4e00-\u9fff]{{1,2}}",
        "[REDACTED_PERSON]", 3, needs="cjk",
    ),
    Sensitive(
        "CN_NAME_GENERIC",
        rf"(?<![\u4e00-\u9fff])(?:[{FAMILY_NAMES}])[\u4e00-\u9fff]{{1,2}}(?![\u4e00-\u9fff])",
        "[REDACTED_PERSON]", 4, needs="cjk",
    ),
    Sensitive("EN_NAME", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b", "[REDACTED_PERSON]", 5),
    Sensitive(
        "ADDRESS",
        r"(?:地址|住址|住所|地址為|地址为|戶籍|户籍)[：:\s]*(?!\[REDACTED)([^\s，。；;\[：:]{4,})",
        "[REDACTED_ADDRESS]", 17, ("址", "住所", "籍"),
    ),
    Sensitive("MESSAGE_ID", r"<[^<>\s@]+@[^<>\s]+>", "[REDACTED_MESSAGE_ID]", 9, ("@",)),
    Sensitive(
        "WINDOWS_PATH", r"(?:[A-Za-z]:\\[^\s<>\"'|?*]+|\\\\[^\\/\s]+\\[^\s<>\"'|?*]+)", "[REDACTED_PATH]", 7, ("\\",)
    ),
    Sensitive(
        "UNIX_PATH", r"(?<![A-Za-z0-9])(?:/(?:home|Users|tmp|var|etc|opt|private|root)/[^\s<>\"']+)",
        "[REDACTED_PATH]", 8, ("/",),
    ),
    Sensitive("API_KEY", r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED_API_KEY]", 10, ("sk-",)),
    Sensitive("BEARER_TOKEN", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{8,}\b", "[REDACTED_TOKEN]", 11, ("bearer",)),
    Sensitive(
        "PASSWORD_SECRET",
        r"(?i)\b(?:password|passwd|pwd|secret|token|api[_ -]?key)\s*[:=：]\s*([^\s,;，；]+)",
        "[REDACTED_SECRET]", 12, (":", "=", "："),
    ),
    Sensitive("LINE_ID", r"(?i)\bline(?:[\s_-]*id)?[\s:：-]*[A-Za-z0-9._-]{4,}\b", "[REDACTED_LINE_ID]", 13, ("line",)),
    Sensitive("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]", 14, ("@",)),
    Sensitive("TAIWAN_ID", r"(?<![A-Za-z0-9])[A-Za-z][12]\d{8}(?![A-Za-z0-9])", "[REDACTED_TW_ID]", 15, needs="digit"),
    Sensitive("BANK_ACCOUNT", r"(?<![A-Za-z0-9])\d{10,20}(?![A-Za-z0-9])", "[REDACTED_ACCOUNT]", 18, needs="digit"),
    Sensitive(
        "PHONE",
        r"(?<!\d)(?:\+?886[- ]?)?(?:09\d{2}[- ]?\d{3}[- ]?\d{3}|"
        r"0\d{1,2}[- ]?\d{3,4}[- ]?\d{3,4}|\(\d{2,3}\)\s?\d{3,4}[- ]?\d{3,4})(?!\d)",
        "[REDACTED_PHONE]", 16, needs="digit",
    ),
    Sensitive("PHONE", r"(?<!\d)(?:\+?886[- ]?)?(?:09\d{8}|0\d{1,2}[- ]?\d{6,8})(?!\d)", "[REDACTED_PHONE]", 16, needs="digit"),
    Sensitive(
        "ADDRESS",
        r"(?:台北|新北|桃园|台中|台南|高雄|基隆|新竹|苗栗|彰化|南投|云林|嘉义|屏东|宜兰|花莲|台东|澎湖|金门|连江)"
        r"[市縣]?[\u4e00-\u9fff0-9]{0,20}(?:路|街|大道|段)[\u4e00-\u9fff0-9段巷弄號号]{1,30}",
        "[REDACTED_ADDRESS]", 17, ("路", "街", "大道", "段"),
    ),
    Sensitive("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]", 19, needs="digit"),
    Sensitive("USERNAME_HANDLE", r"(?<![\w.])@[A-Za-z0-9_.-]{3,}", "[REDACTED_USERNAME]", 21, ("@",)),
)
SECRETS = (
    Sensitive("API_KEY", r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED_API_KEY]", 1, ("sk-",)),
    Sensitive(
        "PRIVATE_EMAIL",
        r"\b[A-Za-z0-9._%+\-]+@(?!example\.(?:com|org|net|local)\b)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        "[REDACTED_EMAIL]", 2, ("@",),
    ),
    Sensitive("HOME_PATH", r"(?:/home/[^\s\"'<>]+|/Users/[^\s\"'<>]+|[A-Za-z]:\\Users\\[^\s\"'<>]+)", "[REDACTED_PATH]", 3, ("/home/", "/users/", ":\\")),
    Sensitive("CANARY", r"\b(?:RAW|ATTACHMENT)_PRIVATE_CANARY_[A-Z0-9]+\b", "[REDACTED_CANARY]", 0, ("canary",)),
)
FORBIDDEN_NAMES = (
    "bodytext", "combinedtext", "originaltext", "normalizedtext", "htmlbody", "rawemail", "raweml",
    "rawattachment", "attachmentcontent", "attachmenttext", "sender", "senderemail", "recipients", "cc",
    "messageid", "sourcepath", "cachedpath", "apikey", "authorization", "token", "password", "secret",
)
PREFIX_OF_KIND = {
    "PERSON": "PERSON", "TARGET": "TARGET", "TARGET_PERSON": "TARGET", "SOURCE": "SOURCE",
    "WHISTLEBLOWER": "SOURCE", "INFORMANT": "SOURCE", "ORG": "ORG", "ORGANIZATION": "ORG",
    "COMPANY": "COMPANY", "GOVERNMENT_AGENCY": "ORG", "PROJECT": "PROJECT",
}
UNSAFE_ENTITY_PARTS = ("@", "\\", "/home/", "c:\\", "sk-", "line-", "http://", "https://")
# -----------------------------------------------------------------------------

FINDING = "array<struct<kind:string,start:int,end:int,replacement:string,priority:int>>"


def _unicode(regex: str) -> str:
    """Word boundaries, classes and digits over all scripts."""
    return regex.replace("(?i)", "(?iU)", 1) if regex.startswith("(?i)") else "(?U)" + regex


def _matches(text: str, p: Sensitive) -> str:
    """Findings of one pattern, with offsets from the lengths of the parts between matches."""
    regex = _unicode(p.regex)
    if p.regex.startswith(("(?:[" + FAMILY_NAMES, "(?<![\\u4e00-\\u9fff])(?:[" + FAMILY_NAMES, "[\\u4e00-\\u9fff]")):
        # a range test first: a class of many wide characters is slow at every position
        regex = "(?U)(?=[\\u4e00-\\u9fff])" + p.regex
    spans = (
        f"transform(_m, _f -> named_struct('kind', {quote(p.kind)}, 'start', _f.start, 'end', _f.end,"
        f" 'replacement', {quote(p.replacement)}, 'priority', {p.priority}))"
    )
    found = regex_spans(text, regex, spans)
    may = f"{text} RLIKE {quote(regex)}"
    if p.needs:
        may = f"_has.{p.needs} AND {may}"
    if p.hints:
        may = "(" + " OR ".join(f"contains(_has.low, {quote(h)})" for h in p.hints) + f") AND {may}"
    return f"CASE WHEN {may} THEN {found} ELSE cast(array() AS {FINDING}) END"


def candidates(text: str, patterns=SENSITIVE) -> str:
    """All findings of all patterns, overlapping or not."""
    seen = ", ".join(f"'{n}', {text} RLIKE {quote(rx)}" for n, rx in NEEDS.items())
    found = "concat(" + ", ".join(_matches(text, p) for p in patterns) + ")"
    return let("_has", f"named_struct('low', lower({text}), {seen})", found)


def resolve_overlaps(findings: str) -> str:
    """Keep non-overlapping findings: by priority, then position, then the longest; sorted by position.

    Findings in order of position fall into clusters: one begins where a
    finding starts behind the end of all before it.  What is kept in a cluster
    does not depend on the others, so each is settled alone, and the work grows
    with the number of findings and the size of the largest cluster.
    """
    keyed = "array_sort(transform(_c, _f -> named_struct('p', _f.priority, 's', _f.start, 'l', _f.start - _f.end, 'f', _f)))"
    greedy = (
        f"aggregate(transform({keyed}, _k -> _k.f), cast(array() AS {FINDING}), (_a, _f) ->"
        " CASE WHEN exists(_a, _x -> _f.end > _x.start AND _f.start < _x.end) THEN _a ELSE concat(_a, array(_f)) END)"
    )
    ordered = "transform(array_sort(transform({}, _k -> named_struct('s', _k.start, 'f', _k))), _k -> _k.f)"
    # most texts have no overlaps at all; then position order is the answer
    overlap = "exists(transform(_s, (_x, _i) -> _i > 0 AND _x.start < get(_s, _i - 1).end), _b -> _b)"
    begins = "filter(sequence(1, size(_s)), _i -> element_at(_s, _i).start >= element_at(_reach, _i))"
    settled = (
        "flatten(transform(_begin, (_i, _k) -> "
        + let("_c", "slice(_s, _i, coalesce(try_element_at(_begin, _k + 2), size(_s) + 1) - _i)", f"CASE WHEN size(_c) = 1 THEN _c ELSE {ordered.format(greedy)} END")
        + "))"
    )
    clustered = let("_reach", prefix_max("transform(_s, _x -> _x.end)"), let("_begin", begins, settled))
    return let("_s", ordered.format(findings), f"CASE WHEN {overlap} THEN {clustered} ELSE _s END")


def scan(text: str, patterns=SENSITIVE) -> str:
    return let(
        "_c", candidates(text, patterns),
        f"CASE WHEN size(_c) > 0 THEN {resolve_overlaps('_c')} ELSE cast(array() AS {FINDING}) END",
    )


def preview(value: str) -> str:
    """First and last two characters; short values are fully masked."""
    n = f"length({value})"
    return (
        f"CASE WHEN {n} <= 4 THEN repeat('*', {n})"
        f" ELSE concat(substring({value}, 1, 2), repeat('*', {n} - 4), substring({value}, {n} - 1, 2)) END"
    )


def redact(text: str, findings: str) -> str:
    """Replace each finding (sorted, not overlapping) by its token."""
    before = "coalesce(get(_f, _i - 1).end, 0)"
    piece = f"concat(substring({text}, {before} + 1, _x.start - {before}), _x.replacement)"
    tail = f"substring({text}, element_at(_f, -1).end + 1, length({text}))"
    body = f"array_join(concat(transform(_f, (_x, _i) -> {piece}), array({tail})), '')"
    return let("_f", findings, f"CASE WHEN size(_f) = 0 THEN {text} ELSE {body} END")


def mask_identifiers(text: str) -> str:
    """Keep three digits of an account, the letter of an id, the prefix of a phone number."""
    account = r"(?<![A-Za-z0-9])(\d{10,20})(?![A-Za-z0-9])"
    parts = f"split(regexp_replace(replace({text}, {quote(SEPARATOR)}, ' '), {quote(account)}, {quote(SEPARATOR)}), {quote(SEPARATOR)}, -1)"
    hits = f"regexp_extract_all({text}, {quote(account)}, 1)"
    masked = "transform(_h, _d -> concat(substring(_d, 1, 3), repeat('*', length(_d) - 3)))"
    joined = let("_h", hits, let("_p", parts, f"array_join(flatten(zip_with(_p, {masked}, (_a, _b) -> array(_a, coalesce(_b, '')))), '')"))
    t = f"CASE WHEN {text} RLIKE {quote(account)} THEN {joined} ELSE {text} END"
    t = f"regexp_replace({t}, {quote(r'(?<![A-Za-z0-9])([A-Za-z])\d{9}(?![A-Za-z0-9])')}, '$1****')"
    return f"regexp_replace({t}, {quote(r'(?<!\d)(\+?86[- ]?)?(09\d{8}|0\d{1,2}[- ]?\d{6,8})(?!\d)')}, '09********')"


def mask_sender(sender: str) -> str:
    local = f"substring_index({sender}, '@', 1)"
    domain = f"substring({sender}, locate('@', {sender}) + 1)"
    return (
        f"CASE WHEN contains({sender}, '@') THEN concat(substring({local}, 1, 2), '***@', {domain})"
        f" WHEN {sender} <> '' THEN '***' ELSE '?' END"
    )


def hash_ref(value: str, prefix: str = "REF") -> str:
    return f"CASE WHEN {value} <> '' THEN concat({quote(prefix + ':')}, substring(sha2({value}, 256), 1, 20)) ELSE '' END"


def safe_entity(text: str) -> str:
    parts = string_array(UNSAFE_ENTITY_PARTS)
    return (
        f"(trim({text}) <> '' AND NOT exists({parts}, _t -> contains(lower({text}), _t))"
        f" AND length(regexp_replace({text}, '[^0-9]', '')) < 6)"
    )


def kind_prefix(kind: str) -> str:
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in PREFIX_OF_KIND.items())
    plain = f"replace(upper({kind}), '-', '_')"
    return f"coalesce(map({pairs})[{plain}], nullif(regexp_replace({plain}, '[^A-Z0-9_]', '_'), ''), 'ENTITY')"
