"""Text normalisers and extractors as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = r"[\u4e00-\u9fff]"
#: All white space there is, spelled out: Java's own class is ASCII, and its Unicode mode is slow
#: and lacks the separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: White space that isn't one blank already.  The range that is asked first spares most characters the long class.
UNEVEN = rf"(?=[^!-~])(?: {SPACE}|(?! ){SPACE})"

# The patterns by which publication records are told from other lines.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
ARXIV = r"(?i)\barxiv\s*:?\s*\d{4}\.\d{4,5}(?:v\d+)?\b"
NUMBERED = r"(?=\d)(?<!\S)(?=\d{1,2}[、.)）]\s+)"
SIGNAL = (
    r"(?i)(?:journal|proceedings|conference|transactions|letters|annals|biometrika|econometrica|statistica|springer"
    r"|wiley|elsevier|siam|ieee|acm|accepted|forthcoming|in\s+press|to\s+appear|submitted|preprint|volume"
    r"|\bvol\.?\s*\d|\bissue\s*\d|\bpp?\.\s*\d|期刊|学报|杂志|会议|出版社|出版|第\s*\d+\s*[卷期]"
    r"|(?:19|20)\d{2}年\s*第?\s*\d+\s*期|\d+\s*\(\s*\d+\s*\)|录用|接收|发表|预印本|论著|专著|论文链接|paper\s+link)"
)
CAREER = (
    r"(?i)(?:教育经历|工作经历|任职经历|学习经历|个人经历|毕业于|加入.{0,30}(?:大学|学院|研究院)"
    r"|(?:获得?|获).{0,12}(?:学位|博士|硕士|学士)|\d{4}[-/.年]\d{1,2}.{0,30}至|\d{4}.{0,20}至今|准聘|长聘|副主任|现任"
    r"|assistant\s+professor|associate\s+professor)"
)
PROJECT = r"(?i)(?:基金|项目|课题|横向|纵向).{0,80}(?:主持|负责人|资助|编号|项目)"
AWARD = r"(?i)(?:获奖|奖励|荣誉|成果奖|教学奖|一等奖|二等奖|三等奖|award)"
#: Strings that stand for a missing value in publication data.
MISSING = ("", "nan", "nat", "none", "<na>")
EMAIL = r"[\w.\-+]+@[\w.\-]+\.\w+"
# What is taken off identifiers and titles before they are compared.
DOI_ADDRESS, DOI_LABEL, DOI_END = r"^https?://(?:dx\.)?doi\.org/", r"^doi\s*:\s*", r"[.,;)]+$"
ARXIV_ADDRESS, ARXIV_LABEL, ARXIV_FILE = r"^https?://arxiv\.org/(?:abs|pdf)/", r"^arxiv\s*:\s*", r"\.pdf$"
ARXIV_ID, ARXIV_VERSION = r"(?:[a-z.-]+/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?", r"v\d+$"
TITLE_MARKS = r"\\(?:emph|textit|textbf|mathrm|mathbf)\s*\{([^{}]*)\}"
#: The target of an anchor, wherever it stands in the tag and however it is quoted.
ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, expression: Callable[[Column], Column]) -> Column:
    """``expression`` of a value that is worked out once, however often it is named.

    Filters and generators would else repeat the value wherever it stands.
    """
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def collapse(value: Column | str) -> Column:
    """White space of any kind to single blanks, none at the ends; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), UNEVEN, " "))


def norm_text(value: Column | str) -> Column:
    """``collapse``, and the string nan is missing."""
    return F.when(F.lower(F.left(_col(value), F.lit(4))) == "nan", "").otherwise(collapse(value))


def norm_evidence(value: Column | str) -> Column:
    """``collapse`` with the wider set of missing values that publication data uses."""
    raw = F.coalesce(_col(value), F.lit(""))
    return F.when(F.lower(F.left(F.trim(raw), F.lit(5))).isin(*MISSING), "").otherwise(collapse(raw))


def has_cjk(value: Column | str) -> Column:
    return F.rlike(_col(value), F.lit(CJK))


def unique_join(values: Column, sep: str = "; ") -> Column:
    """Distinct non-empty normalised values of an array, joined in their first order."""
    clean = F.filter(F.transform(values, lambda v: norm_text(v)), lambda v: v != "")
    return F.array_join(F.array_distinct(clean), sep)


def normalized_name(value: Column | str) -> Column:
    return F.regexp_replace(F.lower(norm_evidence(value)), r"[^a-z0-9\u4e00-\u9fff]", "")


@F.pandas_udf(StringType())
def _title_key(values: pd.Series) -> pd.Series:
    marks, kept, wide = re.compile(TITLE_MARKS, re.ASCII), re.compile("[a-z0-9\u4e00-\u9fff]+"), re.compile("[\u4e00-\u9fff]")
    dropped = bytes(c for c in range(128) if not kept.fullmatch(chr(c)))

    def key(value: str) -> str:
        text = value.lower() if value.isascii() else unicodedata.normalize("NFKC", value).casefold()
        text = marks.sub(r"\1", text) if "\\" in text else text
        if not text.isascii() and wide.search(text):
            return "".join(kept.findall(text))
        return text.encode("ascii", "ignore").translate(None, dropped).decode()

    return values.map(key, na_action="ignore")


def normalized_title(value: Column | str, ascii_only: bool = False) -> Column:
    """Compatibility form, folded case, LaTeX marks removed, letters and digits kept.

    Spark has no compatibility normal form; ``ascii_only`` leaves it out for data that
    doesn't need it and keeps the expression on the JVM.
    """
    text = norm_evidence(value)
    if not ascii_only:
        # White space is dropped in the end, so it is evened only where it may stand within a mark.
        raw = F.coalesce(_col(value), F.lit(""))
        missing = F.lower(F.left(F.trim(raw), F.lit(5))).isin(*MISSING)
        return _title_key(F.when(missing, "").when(F.contains(raw, F.lit("\\")), collapse(raw)).otherwise(raw))
    text = F.regexp_replace(F.lower(text), TITLE_MARKS, "$1")
    return F.regexp_replace(text, r"[^a-z0-9\u4e00-\u9fff]", "")


def normalize_doi(value: Column | str) -> Column:
    text = F.regexp_replace(F.lower(norm_evidence(value)), DOI_ADDRESS, "")
    found = F.regexp_extract(F.regexp_replace(text, DOI_LABEL, ""), DOI, 0)
    return F.regexp_replace(found, DOI_END, "")


def normalize_arxiv_id(value: Column | str) -> Column:
    text = F.regexp_replace(F.lower(norm_evidence(value)), ARXIV_ADDRESS, "")
    text = F.regexp_replace(F.regexp_replace(text, ARXIV_LABEL, ""), ARXIV_FILE, "")
    return F.regexp_replace(F.regexp_extract(text, ARXIV_ID, 0), ARXIV_VERSION, "")


def author_key(value: Column | str) -> Column:
    """Letters of a name without a trailing number that tells namesakes apart."""
    bare = F.regexp_replace(F.lower(norm_evidence(value)), r"\s*\d{4}$", "")
    return F.regexp_replace(bare, r"[^a-z]", "")


def emails(value: Column | str) -> Column:
    """Distinct lower-case addresses in order."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(norm_text(value)), F.lit(EMAIL), F.lit(0))))
    return F.when(F.coalesce(F.contains(_col(value), F.lit("@")), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def years(value: Column | str) -> Column:
    """Years 1900 to 2099, as numbers, in order of appearance."""
    found = F.regexp_extract_all(_col(value), F.lit(YEAR), F.lit(0))
    none = ~(F.contains(_col(value), F.lit("19")) | F.contains(_col(value), F.lit("20")))
    return F.when(none, F.array().cast("array<int>")).otherwise(F.transform(found, lambda y: y.cast("int")))


def first_year(value: Column | str) -> Column:
    return F.get(years(value), F.lit(0))


def split_entries(value: Column | str) -> Column:
    """Publication entries of a text: its lines, cut again before numbers like ``2.``."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), r"\r\n|[\n\r]"), collapse), lambda v: v != "")
    # Lines are collapsed, so their parts have blanks too many only at the ends.
    parts = F.flatten(F.transform(lines, lambda v: F.transform(F.split(v, NUMBERED), lambda x: F.trim(x))))
    return F.filter(parts, lambda v: v != "")


def is_publication(value: Column | str) -> Column:
    """Whether a line reads like a publication record and not like a career note, project or award."""

    def judge(text: Column) -> Column:
        def has(pattern: str) -> Column:
            return F.rlike(text, F.lit(pattern))

        # Plain searches for what a pattern needs go before it.
        identified = (F.contains(text, F.lit("10.")) & has(DOI)) | (F.contains(F.lower(text), F.lit("arxiv")) & has(ARXIV))
        dated = (F.contains(text, F.lit("19")) | F.contains(text, F.lit("20"))) & has(YEAR)
        latin = F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'-]{2,}"), F.lit(0))) >= 4
        quoted = F.contains(text, F.lit("《")) & F.contains(text, F.lit("》"))
        # Nearly all lines lack a year, so that is asked first.
        plain = dated & ~(has(CAREER) | has(PROJECT) | has(AWARD)) & (has(SIGNAL) | quoted | (latin & has(r"[.,;:()]")))
        return (F.length(text) >= 12) & (plain | identified)

    return let(norm_evidence(value), judge)


def cut_at(value: Column, markers: list[str]) -> Column:
    """The text before the first of the markers."""
    places = [F.when(F.locate(m, value) > 0, F.locate(m, value)) for m in markers]
    end = F.least(*places) if len(places) > 1 else places[0]
    return F.trim(F.when(end.isNull(), value).otherwise(F.call_function("substring", value, F.lit(1), end - 1)))


def labelled_value(value: Column, label: str, stops: list[str]) -> Column:
    """What stands between a label and the nearest stop; empty without the label."""
    start = F.locate(label, value)
    rest = F.call_function("substring", value, start + len(label), F.length(value))
    found = F.regexp_replace(cut_at(rest, stops) if stops else rest, r"^[\s:：]+", "")
    return F.when(start > 0, F.trim(found)).otherwise("")


def snippet(value: Column, needle: Column, around: int = 100) -> Column:
    """Up to ``around`` characters on both sides of a needle; null if it isn't there."""
    at = F.instr(value, needle)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.call_function("substring", value, start, at - start + F.length(needle) + around))


def strip_control(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def html_text(html: Column) -> Column:
    """Visible text by expressions: scripts, styles and tags out, the common entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def html_links(html: Column) -> Column:
    """Targets of anchors in order, quotes taken off; null has none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
