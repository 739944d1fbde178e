"""Which links of a person's page lead to a homepage: rules over (href, text) structs, the better ones before the others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.identity import dedup_url
from dossier.functions.text import norm_text

# Hosts that many people share, hosts of papers and profiles, words of a homepage's anchor, marks of a person's host, stray signs.
COMMON_HOSTS = (
    "www.nju.edu.cn", "ic.nju.edu.cn", "njusz.nju.edu.cn", "www.ruc.edu.cn", "sc.ruc.edu.cn", "www.fudan.edu.cn", "ai.fudan.edu.cn", "ciram.fudan.edu.cn",
    "cse.seu.edu.cn", "aiia.seu.edu.cn", "ai.seu.edu.cn", "cs.seu.edu.cn", "jssec.seu.edu.cn", "palm.seu.edu.cn", "cs.tongji.edu.cn", "see.tongji.edu.cn",
    "www.tongji.edu.cn", "www.zju.edu.cn", "www.cs.zju.edu.cn", "www.cse.zju.edu.cn", "ai.zju.edu.cn", "person.zju.edu.cn", "mypage.zju.edu.cn", "zjui.intl.zju.edu.cn",
    "www.ustc.edu.cn", "faculty.ustc.edu.cn", "faculty-en.ustc.edu.cn", "manage.faculty.ustc.edu.cn", "www.lamda.nju.edu.cn", "www.fudanmagiclab.com", "dml.fudan.edu.cn",
)
PAPER_HOSTS = (
    "scholar.google.com", "dblp.org", "dblp.uni-trier.de", "doi.org", "dl.acm.org", "ieeexplore.ieee.org", "link.springer.com", "orcid.org", "www.orcid.org", "researchgate.net",
    "www.researchgate.net",
)
SECTION_HOSTS = ("www.nju.edu.cn", "ic.nju.edu.cn", "keysoftlab.nju.edu.cn", "cselab.nju.edu.cn", "software.nju.edu.cn", "cc.nju.edu.cn", "jw.nju.edu.cn")
SAYS_HOME = ("个人主页", "个人网站", "主页", "homepage", "home page", "实验室", "课题组", "lab")
SAYS_PERSON = ("主页", "homepage", "个人", "实验室")
SAYS_OWN = ("个人主页", "homepage")
PERSON_HOSTS = r"github\.io$|^sites\.google\.com$|lab|group|faculty\."
STRAY = "，,；;。)）]"
NO_LINKS = ("#", "--", "javascript:;")

# Addresses that many rows share, a host of none but these, and start pages of two schools.
SHARED_URLS = (
    "https://chenyang10.github.io/chengyang", "https://manage.faculty.ustc.edu.cn/system/caslogin.jsp", "http://sc.ruc.edu.cn/department/ssai/ssai_users/index.htm", "http://www.fudanmagiclab.com",
    "https://dml.fudan.edu.cn",
)
SHARED_HOST = "aiia.seu.edu.cn"
START_PATHS = ("", "/", "/index.htm", "/index.html")
SCHOOL_STARTS = {
    ("www.cad.zju.edu.cn", "cad.zju.edu.cn"): ("", "/", "/english.html"),
    ("cs.seu.edu.cn", "cse.seu.edu.cn"): ("", "/", "/dsxx/list.htm", "/54820/list.htm"),
}

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def host_of(url: Column) -> Column:
    return F.lower(_part(url, 2))


def _segments(path: Column) -> Column:
    """A path without its dot segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    whole = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    joined = F.array_join(whole, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))  # `..` at the root stays there


def resolve(base: Column, href: Column) -> Column:
    """The address that ``href`` means on the page ``base``, as browsers read it; an address of its own stays as it is."""
    scheme, host, path = (_part(base, k) for k in (1, 2, 3))
    own, query, fragment = _part(href, 3), _part(href, 4), _part(href, 5)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    below = F.regexp_replace(F.concat(F.when(folder == "", "/").otherwise(folder), own), "(?<=.)/{2,}", "/")
    return (
        F.when(href == "", base)
        .when(_part(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(own == "", F.concat(root, path, F.when(query != "", query).otherwise(_part(base, 4)), fragment))
        .otherwise(F.concat(root, _segments(F.when(own.startswith("/"), own).otherwise(below)), query, fragment))
    )


def _says(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def _links(links: Column, base: Column, clean: bool = False) -> Column:
    """``array<struct<href, host, path, fragment, text>>`` of the links that are web addresses once resolved; normal, lower-cased text."""
    stray = F.lit(STRAY)
    raw = lambda a: F.btrim(norm_text(a["href"]), stray) if clean else F.coalesce(a["href"], F.lit(""))
    given = F.filter(links, lambda a: a.isNotNull() & a["href"].isNotNull())
    if clean:
        given = F.filter(given, lambda a: ~raw(a).isin("", *NO_LINKS))
    made = F.transform(given, lambda a: F.struct((F.btrim(resolve(base, raw(a)), stray) if clean else resolve(base, raw(a))).alias("href"), F.lower(norm_text(a["text"])).alias("text")))
    made = F.filter(made, lambda a: a["href"].startswith("http://") | a["href"].startswith("https://"))
    return F.transform(made, lambda a: F.struct(
        a["href"].alias("href"), host_of(a["href"]).alias("host"), F.lower(F.regexp_replace(_part(a["href"], 3), "/+$", "")).alias("path"), _part(a["href"], 5).alias("fragment"), a["text"].alias("text")
    ))


def _hrefs(links: Column) -> Column:
    return F.array_distinct(F.transform(links, lambda a: a["href"]))


def _is_paper(host: Column) -> Column:
    return host.isin(*PAPER_HOSTS) | F.contains(host, F.lit("dblp."))


def outside_links(links: Column, base: Column) -> Column:
    """Addresses on other hosts, and those whose text speaks of a homepage; in order, each once."""
    return _hrefs(F.filter(_links(links, base), lambda a: ((a["host"] != "") & (a["host"] != host_of(base))) | _says(a["text"], SAYS_PERSON)))


def clean_homepages(links: Column, base: Column) -> Column:
    """Addresses whose text names a homepage, or if there are none, those on hosts that look like a person's.

    Hosts that people share, papers, links to a passage and the page itself are left out; signs that stray at the ends go.
    """
    path = F.lower(F.regexp_replace(_part(base, 3), "/+$", ""))

    def kept(a: Column) -> Column:
        own = (a["host"] == host_of(base)) & (a["path"] == path)
        return ~a["fragment"].startswith("#:~:text") & ~a["host"].isin(*COMMON_HOSTS) & ~_is_paper(a["host"]) & ~own

    good = F.filter(_links(links, base, True), kept)
    direct = F.filter(good, lambda a: _says(a["text"], SAYS_HOME))
    other = F.filter(good, lambda a: F.rlike(a["host"], F.lit(PERSON_HOSTS)))
    return _hrefs(F.when(F.size(direct) > 0, direct).otherwise(other))


def section_homepages(links: Column, base: Column, found: Column | None = None) -> Column:
    """Addresses of a section that lie elsewhere or speak of a homepage, and those ``found`` in its text; shared hosts and papers left out."""
    common = lambda host: host.isin(*SECTION_HOSTS, *COMMON_HOSTS) | _is_paper(host)
    kept = F.filter(_links(links, base), lambda a: ~common(a["host"]) & ((a["host"] != host_of(base)) | _says(a["text"], SAYS_PERSON)))
    hrefs = F.transform(kept, lambda a: a["href"])
    if found is not None:
        hrefs = F.concat(hrefs, F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda u: ~common(host_of(u))))
    return F.array_distinct(hrefs)


def one_homepage(links: Column, base: Column) -> Column:
    """The first address on another host whose text names a homepage, else the first on another host, else empty."""
    other = F.filter(_links(links, base), lambda a: a["host"] != host_of(base))
    named = F.filter(other, lambda a: _says(a["text"], SAYS_OWN))
    first = lambda found: F.get(F.transform(found, lambda a: a["href"]), F.lit(0))
    return F.coalesce(first(named), first(other), F.lit(""))


def is_shared_url(url: Column) -> Column:
    """Whether an address in the form of ``dedup_url`` says nothing about who a directory's row is."""
    path, host = F.regexp_replace(_part(url, 3), "/+$", ""), host_of(url)
    common = host.isin(*COMMON_HOSTS) & (path.isin(*START_PATHS) | path.endswith("/list.htm"))
    starts = reduce(Column.__or__, [host.isin(*hosts) & path.isin(*paths) for hosts, paths in SCHOOL_STARTS.items()])
    return (url == "") | F.regexp_replace(url, "/$", "").isin(*SHARED_URLS) | host.isin(*PAPER_HOSTS, SHARED_HOST) | (_part(url, 5) != "") | common | starts


def directory_keys(personal: Column, profile: Column) -> Column:
    """Keys by which rows of directories are the same person: their own addresses, the homepage first; those with a mark in the page and shared ones are none."""
    own = F.transform(F.array(personal, profile), lambda u: F.when(~F.contains(norm_text(u), F.lit("#")), dedup_url(u)))
    kept = F.filter(own, lambda u: u.isNotNull() & ~is_shared_url(u))
    return F.array_distinct(F.transform(kept, lambda u: F.concat(F.lit("url:"), u)))
