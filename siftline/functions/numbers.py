"""Amounts, number words, dates, identifiers and complaint measures as SQL expressions."""

from __future__ import annotations

from siftline.functions.sql import any_contains, let, quote, string_array, wide_class
from siftline.functions.text import SEPARATOR, regex_spans

# --- Fixed values that decide the results -----------------------------------
DIGIT_WORDS = "零一二三四五六七八九"
DIGIT_ALIASES = ("〇两兩", "零二二")
FORMAL_DIGITS = ("壹贰叁肆伍陆柒捌玖", "一二三四五六七八九")
TENS, HUNDREDS, THOUSANDS, MYRIADS, HUNDRED_MILLIONS = "十拾", "百佰", "千仟", "万萬", "亿億"
UNIT_FACTORS = {
    "万亿": 10**12, "萬億": 10**12, "千万": 10**7, "千萬": 10**7, "百万": 10**6, "百萬": 10**6, "万": 10000, "萬": 10000, "亿": 100000000, "億": 100000000, "千": 1000, "百": 100,
}
SUFFIX_CURRENCY = {
    "人民币": "CNY", "人民幣": "CNY", "新台币": "TWD", "新臺幣": "TWD", "台币": "TWD", "臺幣": "TWD",
    "美元": "USD", "美金": "USD", "港币": "HKD", "港幣": "HKD",
}
MARK_CURRENCY = {"nt$": "TWD", "rmb": "CNY", "us$": "USD", "hk$": "HKD", "cn¥": "CNY", "£": "GBP", "€": "EUR"}
DEFAULT_CURRENCY = "TWD"
AMOUNT_CORE = (
    r"(?=\d)(?<![A-Za-z0-9年])(\d{1,3}(?:,\d{3})+|\d+\.?\d*)\s*(万亿|萬億|千万|千萬|百万|百萬|亿|億|万|萬|千|百)?\s*"
    r"(新台币|新臺幣|台币|臺幣|人民币|人民幣|美金|美元|港币|港幣|元|塊|圆|圓)?(?![A-Za-z0-9%])"
)
AMOUNT_WORD_CHARS = "零〇一二三四五六七八九十百千万亿點点两兩壹贰叁肆伍陆柒捌玖拾佰仟兆"
AMOUNT_PARTS = (
    r"^(\d{1,3}(?:,\d{3})+|\d+\.?\d*)\s*(万亿|萬億|千万|千萬|百万|百萬|亿|億|万|萬|千|百)?\s*"
    r"(新台币|新臺幣|台币|臺幣|人民币|人民幣|美金|美元|港币|港幣|元|塊|圆|圓)?$"
)
AMOUNT_WORDS = (
    f"(?=[{wide_class(AMOUNT_WORD_CHARS)}])(?<![0-9{wide_class(AMOUNT_WORD_CHARS)}])([{wide_class(AMOUNT_WORD_CHARS)}]+)\\s*"
    "(?:(万亿|億|万|萬|亿|千|百|仟|佰)?\\s*(元|块|塊|圓|圆|美金|美元)|(万亿|億|万|萬|亿))"
)
NEAR_CHARS = 12
# a mark in letters is a word of its own, and one in ``$`` has just one; a mark needs a character on both sides
CURRENCY_MARK = (
    r"(?is)(?<=.)(新台币|新臺幣|台币|臺幣|人民币|人民幣|美金|美元|港币|港幣|(?<!\p{IsLatin})(?:(?:nt|us|hk)\$(?!\$)|rmb(?!\p{IsLatin})|cn¥)|£|€)(?=.)"
)
CURRENCY_WORD = r"(?is)(?<=.)(?<!\p{IsLatin})ntd(?=\P{IsLatin})"
DATE_REGEX = (
    r"((?:19|20)\d{2}\s*[年./\-]\s*\d{1,2}\s*[月./\-]\s*\d{1,2}\s*日?"
    r"|(?:19|20)\d{2}\s*年\s*\d{1,2}\s*月|\d{1,2}\s*月\s*\d{1,2}\s*日)"
)
ACCOUNT_REGEX = r"(?<![A-Za-z0-9])(\d{10,20})(?![A-Za-z0-9])"
PHONE_REGEX = r"(?<!\d)(09\d{8}|02[- ]?\d{7,8}|0\d{1,2}[- ]?\d{6,8})(?!\d)"
EMAIL_REGEX = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
COUNT_CHARS = "零〇一二三四五六七八九十百千万亿兩两壹贰叁肆伍陆柒捌玖拾佰仟萬億"
# no unit begins with a character of a count: a run is taken whole or not at all, and from its start only
COUNT_REGEX = rf"(?<!\d)\d[\d,]*+|(?<![{wide_class(COUNT_CHARS)}])[{wide_class(COUNT_CHARS)}]++"
COUNT_AHEAD = rf"(?=[\d{wide_class(COUNT_CHARS)}])"
PEOPLE_UNITS = "户|戶|个家庭|個家庭|家庭|人|名|位|家"
AT_LEAST = ["超过", "逾", "至少"]
ABOUT = ["约", "大约", "近", "约莫"]
PREFIXES = "超过|逾|至少|约莫|约|大约|近"
VAGUE_COUNTS = {
    "数百": 300, "數百": 300, "几百": 300, "幾百": 300, "数十": 30, "數十": 30,
    "上千": 1000, "上万": 10000, "上萬": 10000,
}
EXACT_SPANS = {
    "半年": 180, "六个月": 180, "六個月": 180, "一个月": 30, "一個月": 30, "一周": 7, "一星期": 7,
}
VAGUE_SPANS = {
    "连续数月": 90, "連續數月": 90, "数月": 90, "數月": 90, "几个月": 90, "幾個月": 90,
    "多年": 1095, "数年": 1095, "數年": 1095, "超过一星期": 7, "超過一星期": 7,
}
SPAN_UNITS = {
    "天": 1.0, "日": 1.0, "周": 7.0, "週": 7.0, "星期": 7.0, "个月": 30.0, "個月": 30.0, "月": 30.0,
    "年": 365.0, "小时": 1 / 24, "小時": 1 / 24, "钟头": 1 / 24, "鐘頭": 1 / 24,
}
OFTEN_TERMS = [
    "多次", "多次反映", "反复", "反覆", "连续投诉", "連續投訴", "打了七次电话", "打了七次電話",
    "多次打", "屡次", "屢次",
]
COMPLAINT_TERMS = [
    "1999", "市长信箱", "市長信箱", "陈情", "陳情", "投诉", "投訴", "申诉", "申訴",
    "找议员", "找議員", "找里长", "找里長",
]
DEADLINE_TERMS = [
    "截止", "期限", "到期", "即将到期", "即將到期", "最后期限", "最後期限", "申请截止", "申請截止",
    "逾期", "补件期限", "補件期限",
]
# A span in years above this is a calendar year such as 2024年, not a duration.
MAX_YEARS = 150
# -----------------------------------------------------------------------------


def _all(text: str, regex: str, group: int) -> str:
    return f"regexp_extract_all({text}, {quote(regex)}, {group})"


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in values.items()) + ")"


def whole_number_words(words: str) -> str:
    """Value of a whole number written in number words; NULL when a character is unknown."""
    state = "named_struct('total', {t}, 'section', {s}, 'number', {n}, 'ok', {ok})"

    def times(factor: str) -> str:
        grown = f"a.section + (CASE WHEN a.number = 0D THEN 1D ELSE a.number END) * {factor}"
        return state.format(t="a.total", s=grown, n="0D", ok="a.ok")

    def close(total: str) -> str:
        return state.format(t=total, s="0D", n="0D", ok="a.ok")

    plain = f"translate({words}, {quote(DIGIT_ALIASES[0])}, {quote(DIGIT_ALIASES[1])})"
    step = (
        "CASE"
        f" WHEN locate(c, {quote(DIGIT_WORDS)}) > 0 THEN "
        + state.format(t="a.total", s="a.section", n=f"cast(locate(c, {quote(DIGIT_WORDS)}) - 1 AS double)", ok="a.ok")
        + f" WHEN locate(c, {quote(TENS)}) > 0 THEN {times('10D')}"
        f" WHEN locate(c, {quote(HUNDREDS)}) > 0 THEN {times('100D')}"
        f" WHEN locate(c, {quote(THOUSANDS)}) > 0 THEN {times('1000D')}"
        f" WHEN locate(c, {quote(MYRIADS)}) > 0 THEN {close('a.total + (a.section + a.number) * 10000D')}"
        f" WHEN locate(c, {quote(HUNDRED_MILLIONS)}) > 0 THEN {close('(a.total + a.section + a.number) * 100000000D')}"
        " ELSE " + state.format(t="a.total", s="a.section", n="a.number", ok="false") + " END"
    )
    zero = state.format(t="0D", s="0D", n="0D", ok="true")
    total = "CASE WHEN a.ok THEN a.total + a.section + a.number END"
    return (
        f"CASE WHEN {words} <> '' THEN aggregate(filter(split({plain}, ''), c -> c <> ''),"
        f" {zero}, (a, c) -> {step}, a -> {total}) END"
    )


def number_words(words: str) -> str:
    """Value of number words with an optional decimal part (一点五 is 1.5)."""
    digits = f"translate(translate(substring_index(_w, '点', -1), {quote(DIGIT_ALIASES[0])}, {quote(DIGIT_ALIASES[1])}), {quote(DIGIT_WORDS)}, '0123456789')"
    head = whole_number_words("substring_index(_w, '点', 1)")
    # a number such as 点五 has an empty whole part, which is not a number
    tail = f"CASE WHEN {digits} RLIKE '^[0-9]+$' THEN cast(concat('0.', {digits}) AS double) END"
    whole = whole_number_words("_w")
    body = f"CASE WHEN contains(_w, '点') THEN {head} + {tail} ELSE {whole} END"
    return let("_w", f"translate({words}, '點', '点')", body)


def count_value(token: str) -> str:
    """Value of a count written in digits (with commas) or in number words."""
    words = whole_number_words(f"translate(_t, {quote(FORMAL_DIGITS[0])}, {quote(FORMAL_DIGITS[1])})")
    return let("_t", f"trim(replace({token}, ',', ''))", f"CASE WHEN _t RLIKE '^[0-9]+$' THEN cast(_t AS double) ELSE {words} END")


def _near_currency(window: str) -> str:
    """Currency named by a mark in the surrounding characters, if it is one that decides."""
    decided = " ".join(f"WHEN _c = {quote(k)} THEN {quote(v)}" for k, v in MARK_CURRENCY.items())
    found = f"CASE {decided} WHEN _c = '' AND _n RLIKE {quote(CURRENCY_WORD)} THEN 'TWD' END"
    return let("_n", window, let("_c", f"lower(regexp_extract(_n, {quote(CURRENCY_MARK)}, 1))", found))


def _amounts(text: str, core: str, parts: str, groups: tuple[tuple[int, ...], ...], value: str, keep: str, currency: str) -> str:
    """Amounts of one notation.

    ``core`` finds a mention, ``parts`` takes it apart into ``groups`` (of the
    number, the unit and the currency), ``value`` is the number's value and
    ``keep`` the condition.
    """
    suffix = _map(SUFFIX_CURRENCY)
    factor = _map({k: float(v) for k, v in UNIT_FACTORS.items()})
    radius = NEAR_CHARS
    # one character more on either side tells whether a mark at the edge is a whole word
    before = f"CASE WHEN _x.start > {radius} THEN substring({text}, _x.start - {radius}, {radius} + 1) ELSE concat(' ', substring({text}, 1, _x.start)) END"
    near = f"concat({before}, ' ', substring({text}, _x.end + 1, {radius} + 1), CASE WHEN length({text}) - _x.end <= {radius} THEN ' ' ELSE '' END)"
    num, unit, cur = (
        "concat(" + ", ".join(f"regexp_extract(_x.raw, {quote(parts)}, {g})" for g in gs) + ")" for gs in groups
    )
    rows = f"transform(_m, _x -> named_struct('raw', trim(_x.raw), 'num', {num}, 'unit', {unit}, 'cur', {cur}, 'near', CASE WHEN _mk THEN {_near_currency(near)} END))"
    rows = (
        f"transform({rows}, m -> named_struct('raw', m.raw, 'num', m.num, 'unit', m.unit, 'cur', m.cur, 'near', m.near,"
        f" 'value', {value} * coalesce({factor}[m.unit], 1D)))"
    )
    shown = (
        f"transform(filter({rows}, m -> m.value BETWEEN 1D AND 1e13D AND ({keep})), m -> named_struct('amount', round(m.value, 2),"
        f" 'currency', coalesce(m.near, {suffix}[m.cur], {quote(currency)}), 'raw', m.raw))"
    )
    # only a mark asks where a mention stands
    unplaced = f"transform({_all(f'replace({text}, {quote(SEPARATOR)}, {quote(chr(32))})', core, 0)}, _r -> named_struct('start', 0, 'end', 0, 'raw', _r))"
    return let("_m", f"CASE WHEN _mk THEN {regex_spans(text, core, '_m')} ELSE {unplaced} END", shown)


def extract_amounts(text: str, currency: str = DEFAULT_CURRENCY) -> str:
    """array<struct<amount,currency,raw>>: distinct money amounts, smallest first.

    ``currency`` is that of amounts that name none.
    """
    none = "cast(array() AS array<struct<amount:double,currency:string,raw:string>>)"
    by_digits = _amounts(
        text, AMOUNT_CORE, AMOUNT_PARTS, ((1,), (2,), (3,)), "cast(replace(m.num, ',', '') AS double)",
        "m.unit <> '' OR m.cur <> '' OR m.near IS NOT NULL OR contains(m.num, ',')", currency,
    )
    by_words = _amounts(text, AMOUNT_WORDS, f"^{AMOUNT_WORDS}$", ((1,), (2, 4), (3,)), number_words("m.num"), "m.value >= 10D OR m.unit <> ''", currency)
    wide = f"{text} RLIKE {quote(r'[\u4e00-\u9fff]')}"
    # an amount in digits has a thousands comma, a unit or currency in wide characters, or a mark that decides
    marked = let("_low", f"lower({text})", " OR ".join(f"contains(_low, {quote(m)})" for m in (*MARK_CURRENCY, "ntd")))
    in_digits = f"{text} RLIKE {quote(r'\d')} AND ({text} RLIKE {quote(r'\d,\d{3}')} OR {wide} OR _mk)"
    found = f"concat(CASE WHEN {in_digits} THEN {by_digits} ELSE {none} END, CASE WHEN {wide} THEN {by_words} ELSE {none} END)"
    # sorted, equal (amount, currency) lie side by side, the first mention in front
    ranked = "array_sort(transform(_m, (x, i) -> named_struct('amount', x.amount, 'currency', x.currency, 'i', i, 'raw', x.raw)))"
    firsts = (
        "transform(filter(_r, (x, i) -> i = 0 OR x.amount <> get(_r, i - 1).amount OR x.currency <> get(_r, i - 1).currency),"
        " x -> named_struct('amount', x.amount, 'currency', x.currency, 'raw', x.raw))"
    )
    return let("_mk", marked, let("_m", found, f"CASE WHEN size(_m) > 0 THEN {let('_r', ranked, firsts)} ELSE _m END"))


def extract_dates(text: str) -> str:
    """array<string> of dates as written (blanks removed), first mention first."""
    return f"array_distinct(transform({_all(text, DATE_REGEX, 1)}, d -> replace(d, ' ', '')))"


def parse_date(date: str) -> str:
    """DATE of a full year-month-day mention, NULL for partial ones."""
    plain = f"regexp_replace({date}, {quote(r'^(\d{4})[年./-](\d{1,2})[月./-](\d{1,2})日?$')}, '$1-$2-$3')"
    return f"try_to_date({plain}, 'y-M-d')"


def extract_accounts(text: str) -> str:
    return f"array_distinct({_all(text, ACCOUNT_REGEX, 1)})"


def extract_phones(text: str) -> str:
    return f"array_distinct(transform({_all(text, PHONE_REGEX, 0)}, p -> replace(p, ' ', '')))"


def extract_emails(text: str) -> str:
    return f"array_distinct({_all(text, '(?U)' + EMAIL_REGEX, 0)})"


def _in_wide_text(text: str, value: str, otherwise: str = "NULL") -> str:
    """The measures below are written in wide characters; other texts are passed over quickly."""
    return f"CASE WHEN {text} RLIKE {quote(r'[\u4e00-\u9fff]')} THEN {value} ELSE {otherwise} END"


def extract_population(text: str) -> str:
    """struct<value,lower_bound,confidence> of the largest group of people named."""
    # 数百户 and the like are read as vague counts below: here they match without a number
    vague_one = rf"(?<=[数數几幾上近])\s*+[十百千万亿]\s*+(?:{PEOPLE_UNITS})"
    stated = rf"(?:({PREFIXES})\s*+)?({COUNT_REGEX})\s*+(?:{PEOPLE_UNITS})"
    first = wide_class(COUNT_CHARS + "".join(p[0] for p in PREFIXES.split("|")))
    core = rf"(?=[\d\s{first}])(?<!\d(?=\d))(?:{vague_one}|{stated})"
    plain = f"replace({text}, {quote(SEPARATOR)}, ' ')"
    rows = (
        f"transform({_all(plain, core, 2)}, (_n, _i) -> named_struct('value', {count_value('_n')}, 'nth', -_i, 'confidence',"
        f" CASE WHEN array_contains({string_array(AT_LEAST)}, get(_p, _i)) THEN 0.8D"
        f" WHEN array_contains({string_array(ABOUT)}, get(_p, _i)) THEN 0.75D ELSE 0.95D END))"
    )
    rows = let("_p", _all(plain, core, 1), rows)
    best = f"array_max(filter({rows}, m -> m.value > 0))"
    vague_first = "".join(sorted({w[0] for w in VAGUE_COUNTS}))
    vague_rx = rf"(?=[{vague_first}])(" + "|".join(VAGUE_COUNTS) + r")\s*(?:" + PEOPLE_UNITS + ")"
    vague = (
        f"array_max(transform({_all(text, vague_rx, 1)},"
        f" w -> {_map({k: float(v) for k, v in VAGUE_COUNTS.items()})}[w]))"
    )
    raised = "_v IS NOT NULL AND (_b IS NULL OR _v > _b.value)"
    result = (
        f"named_struct('value', CASE WHEN {raised} THEN _v ELSE _b.value END,"
        f" 'lower_bound', CASE WHEN {raised} THEN _v ELSE _b.value END,"
        f" 'confidence', CASE WHEN {raised} THEN greatest(coalesce(_b.confidence, 0D), 0.8D)"
        " ELSE coalesce(_b.confidence, 0D) END)"
    )
    nothing = "named_struct('value', cast(NULL AS double), 'lower_bound', cast(NULL AS double), 'confidence', 0D)"
    return _in_wide_text(text, let("_b", best, let("_v", vague, result)), nothing)


def _largest_present(text: str, days: dict[str, int]) -> str:
    rows = ", ".join(f"CASE WHEN contains({text}, {quote(k)}) THEN {float(v)}D END" for k, v in days.items())
    return f"array_max(array({rows}))"


def extract_duration(text: str) -> str:
    """struct<days,approximate_days>: the longest stated span, exact and vague."""
    units = "|".join(sorted(SPAN_UNITS, key=lambda u: (-len(u), u)))
    rx = rf"{COUNT_AHEAD}({COUNT_REGEX})\s*+({units})"
    factor = _map(SPAN_UNITS)
    rows = f"zip_with({_all(text, rx, 1)}, {_all(text, rx, 2)}, (_n, _u) -> named_struct('n', {count_value('_n')}, 'u', _u))"
    rows = f"filter({rows}, m -> m.n > 0 AND NOT (m.u = '年' AND m.n > {MAX_YEARS}))"
    stated = f"array_max(transform({rows}, m -> round(m.n * {factor}[m.u], 4)))"
    value = (
        f"named_struct('days', greatest({stated}, {_largest_present(text, EXACT_SPANS)}),"
        f" 'approximate_days', {_largest_present(text, VAGUE_SPANS)})"
    )
    return _in_wide_text(text, value, "named_struct('days', cast(NULL AS double), 'approximate_days', cast(NULL AS double))")


def extract_frequency(text: str) -> str:
    """struct<frequency,complaint_count>: how often something happened or was reported."""
    counted = f"array_max(transform({_all(text, rf'{COUNT_AHEAD}({COUNT_REGEX})\s*+次', 1)}, n -> {count_value('n')}))"
    counted = _in_wide_text(text, counted)
    often = f"CASE WHEN {any_contains(text, OFTEN_TERMS)} THEN 3D END"
    complaints = f"nullif(cast(size(filter({string_array(COMPLAINT_TERMS)}, _t -> contains({text}, _t))) AS double), 0D)"
    named = f"named_struct('frequency', coalesce(greatest(nullif({counted}, 0D), {often}), _k), 'complaint_count', _k)"
    return let("_k", complaints, named)


def extract_loss(text: str) -> str:
    """Largest amount named, or the first plain figure with a money unit."""
    rx = r"(\d+(?:\.\d+)?)\s*(万|萬|元)"
    amount = f"cast(regexp_extract({text}, {quote(rx)}, 1) AS string)"
    unit = f"regexp_extract({text}, {quote(rx)}, 2)"
    plain = f"try_cast({amount} AS double) * (CASE WHEN {unit} IN ('万', '萬') THEN 10000D ELSE 1D END)"
    return f"coalesce(array_max(transform({extract_amounts(text)}, m -> m.amount)), {_in_wide_text(text, plain)})"


def extract_waiting(text: str) -> str:
    """Days of waiting stated first in the text."""
    rx = rf"(?=[等排])(?:等床|等候|等待|排队|排隊|等)\s*({COUNT_REGEX})\s*(天|日|周|週|个月|個月|月)"
    unit = f"regexp_extract({text}, {quote(rx)}, 2)"
    number = let("_n", f"regexp_extract({text}, {quote(rx)}, 1)", f"CASE WHEN _n <> '' THEN {count_value('_n')} END")
    days = f"{number} * (CASE WHEN contains({unit}, '月') THEN 30D WHEN {unit} IN ('周', '週') THEN 7D ELSE 1D END)"
    return _in_wide_text(text, days)


def deadline_pressure(text: str) -> str:
    return any_contains(text, DEADLINE_TERMS)
