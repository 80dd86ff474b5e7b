"""Column functions on text: normalising, extracting, redacting, counting, naming."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a line, and full-width marks with their ASCII forms.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FULL_WIDTH, ASCII = "，。：；！？（）【】［］％＋－＝＜＞／", ",.:;!?()[][]%+-=<>/"
#: A small table of traditional and simplified characters, one for one.
TRADITIONAL, SIMPLIFIED = "學習實體價說關問題經濟國書電會計門間開見現對數據", "学习实体价说关问题经济国书电会计门间开见现对数据"

#: How numbers, operators, citations, labels, diagrams and secrets are written.
NUMBER = r"(?U)(?:\d+(?:[.,]\d+)*%?|%\d+)"
OPERATOR = r"(?:<=|>=|!=|==|=|<|>|\+|-|\*|/|\^)"
CITATION = r"\[(?:src|att):[^\]\s]+\]"
LABEL = r"\[《[^》]+》·第 \d+ 章\]"
MERMAID = r"(?is)```mermaid\s*\n(.*?)```"
SECRET_RULES = (
    (r"file://[^\s)]+", "[REDACTED]"),
    (r"(?:/Users/|/home/|/private/)[^\s)]+|[A-Za-z]:\\[^\s)]+", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{8,}", "[REDACTED]"),
    (r"(?i)\b(api_?key|token|secret|password)(\s*[:=]\s*)[^\s,;]+", "$1$2[REDACTED]"),
)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_ocr_text(text: Column) -> Column:
    return squeeze(F.translate(F.translate(text, FULL_WIDTH, ASCII), TRADITIONAL, SIMPLIFIED))


def compared(text: Column) -> Column:
    """Text as two observers' readings are compared: normalised, without spaces."""
    return F.replace(normalize_ocr_text(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def operators(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(OPERATOR), F.lit(0))


def text_conflict(left: Column, right: Column) -> Column:
    """Null if both read the same; else what kind of difference comes first: numbers, operators, other text."""

    def kind(z: Column) -> Column:
        a, b = z["a"], z["b"]
        differ = F.when(numbers(a) != numbers(b), "numeric_conflict").when(operators(a) != operators(b), "formula_operator_conflict").otherwise("text_conflict")
        return F.when(a != b, differ)

    once = F.array(F.struct(compared(left).alias("a"), compared(right).alias("b")))
    return F.when(~left.eqNullSafe(right), F.transform(once, kind)[0])


def sample_bucket(page_hash: Column, page: Column) -> Column:
    """0 to 9,999 from the first 64 bits of the SHA-256 of hash:page."""
    head = F.substring(F.sha2(F.concat_ws(":", page_hash, page.cast("string")), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(10000)).cast("int")


def escalation_reason(status: Column, page_hash: Column, page: Column, rate: float) -> Column:
    return (
        F.when(status == "conflict", "CONFLICT")
        .when(status == "complex", "COMPLEX")
        .when(sample_bucket(page_hash, page) < int(rate * 10000), "SAMPLE")
    )


#: What is taken out of files that are written to a folder, of titles, and of what another engine answers.
FOLDER_RULES = (
    (r"file://[^\s<>()]+", "[REDACTED]"),
    (r"(?<![\p{L}\p{N}_:/.])/(?:[^\s/<>()\[\]{}'\"`]+/)*[^\s/<>()\[\]{}'\"`]+", "[REDACTED]"),
    (r"[A-Za-z]:\\[^\s<>()]+", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|secret)\s*[:=]\s*[^\s]+", "[REDACTED]"),
)
TITLE_RULES = (
    (r"/Users/[^\s]+|/private/[^\s]+|[A-Za-z]:\\[^\s]+", "[REDACTED]"),
    (r"(?i)\b(?:sk|key|token)-[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
)
ANSWER_RULES = (
    (r"(?i)(\"?(?:key|token|access_token|api_key)\"?\s*:\s*\")[^\"]*(\")", "$1[REDACTED]$2"),
    (r"(?i)sk-[A-Za-z0-9_-]+|Bearer\s+[^\s,}]+|/Users/[^\s,}]+|/var/[^\s,}]+|\b(?:key|token|access_token|api_key)\s*[:=]\s*[\"']?[^\s,}\"']+", "[REDACTED]"),
)


def redact(text: Column, rules: tuple[tuple[str, str], ...] = SECRET_RULES) -> Column:
    """The text with what the rules find replaced, rule by rule."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def safe_markdown(text: Column, most: int = 8192) -> Column:
    """One line that opens no fence and no tag."""
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    for a, b in (("```", "'''"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.substring(F.trim(text), 1, most)


def word_tokens(text: Column) -> Column:
    return F.when(squeeze(text) == "", 0).otherwise(F.size(F.split(squeeze(text), " ")))


def over_budget(text: Column, reserve: int, limit: int) -> Column:
    return F.octet_length(text) + reserve > limit


def clean_tags(tags: Column, most: int = 40) -> Column:
    """Trimmed, without repeats, neither empty nor longer than `most`."""
    kept = F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & (F.length(x) <= most))
    return F.array_distinct(kept)


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def source_labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LABEL), F.lit(0))


def source_label(title: Column, seq: Column) -> Column:
    return F.format_string("[《%s》·第 %d 章]", title, seq + 1)


def diagrams(text: Column) -> Column:
    """Bodies of the fenced diagrams, trimmed, empty ones left out."""
    bodies = F.regexp_extract_all(text, F.lit(MERMAID), F.lit(1))
    return F.filter(F.transform(bodies, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: F.length(x) > 0)


def section_title(unit: Column) -> Column:
    title = F.regexp_extract(F.regexp_replace(unit, r"(?U)^\s+", ""), r"(?U)^#{1,6}\s+([^\n]+)", 1)
    return F.when(title == "", "(无标题)").otherwise(title)


def stable_id(number: Column, title: Column) -> Column:
    return F.concat(F.lit("chapter-"), F.substring(F.sha2(F.concat(number, F.lit("\0"), title), 256), 1, 24))


#: Numerals up to ten.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def chapter_number(number: Column, strict: bool = False) -> Column:
    """The key of a heading's number: numerals below a hundred become digits, "chapter" goes.

    strict leaves digits between 第 and 章 as they are; else they count like numerals.
    """
    value = F.lower(F.replace(number, F.lit(" "), F.lit("")))
    raw = F.regexp_extract(value, "^第(.*)章$", 1)
    digit = lambda c: F.coalesce(F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (k, v)])[c], F.lit(0))
    ten = F.instr(raw, "十")
    left, right = F.expr("0"), F.expr("0")
    left = F.when(ten == 1, 1).otherwise(digit(F.substring(raw, F.lit(1), ten - 1)))
    right = F.when(ten == F.length(raw), 0).otherwise(digit(F.substring(raw, ten + 1, F.length(raw))))
    spoken = F.when(F.length(raw) == 1, digit(raw)).otherwise(left * 10 + right).cast("string")
    known = raw.rlike("^[零〇一二两三四五六七八九十]$") | raw.rlike("^[一二两三四五六七八九]?十[零〇一二两三四五六七八九]?$")
    out = F.when(known, spoken)
    if not strict:
        out = out.when(raw.rlike(r"^\d+$"), raw)
    return out.when(value.startswith("chapter"), F.substring(value, 8, 1 << 20)).otherwise(value)


def chapter_level(key: Column) -> Column:
    """How many groups of digits a key has, one at least."""
    return F.greatest(F.regexp_count(key, F.lit("[0-9]+")), F.lit(1))


@F.arrow_udf(T.StringType())
def normalized_title(titles: pa.Array) -> pa.Array:
    """NFKC, case folded, white space squeezed: Spark has no Unicode normal forms."""
    plain = lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split())
    return pa.array([plain(x) for x in titles.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def normalized_titles(lists: pa.Array) -> pa.Array:
    """normalized_title of each title of a list."""
    plain = lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split())
    return pa.array([None if x is None else [plain(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def safe_name(names: pa.Array) -> pa.Array:
    """A file name of at most 180 bytes without control characters, slashes and outer dots; longer ones end in a hash."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        text = "".join(c for c in unicodedata.normalize("NFC", name) if unicodedata.category(c)[0] != "C")
        text = text.replace("/", "-").replace("\\", "-").strip(" .") or "untitled"
        if len(text.encode()) > 180:
            text = text.encode()[:160].decode(errors="ignore") + "-" + hashlib.sha256(text.encode()).hexdigest()[:12]
        return text

    return pa.array([one(x) for x in names.to_pylist()], pa.string())


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes by their union; 0 without area."""
    side = lambda at, size: F.greatest(
        F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at])
    )
    inner = side("x", "width") * side("y", "height")
    union = a["width"] * a["height"] + b["width"] * b["height"] - inner
    return F.when(union == 0, 0.0).otherwise(inner / union)
