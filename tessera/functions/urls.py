"""URLs: canonical form, host, grade of the source behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, and hosts by the kind of source.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
DISCLOSURE_HOSTS = ("cninfo.com.cn", "sse.com.cn", "szse.cn", "bse.cn", "neeq.com.cn", "csrc.gov.cn", "sasac.gov.cn", "gsxt.gov.cn", "hkexnews.hk", "sec.gov")
STATUTORY_HOSTS = ("cninfo.com.cn", "sse.com.cn", "szse.cn", "bse.cn", "neeq.com.cn", "csrc.gov.cn", "sasac.gov.cn", "gsxt.gov.cn", "hkexnews.hk", "sec.gov", "beian.cac.gov.cn")
SELF_PARTS = ("pitchhub.36kr.com", "36kr.com", "weixin.", "shaqiu.cn", "chinapp.net.cn", "zhihu.", "baidu.", "sohu.", "163.com", "qq.com", "toutiao.", "eastmoney.", "10jqka.")
INDEPENDENT_PARTS = ("xinhuanet.", "people.com.cn", "shobserver.")
AGGREGATOR_PARTS = ("baidu.", "sina.", "sohu.", "163.com", "qq.com", "toutiao.", "eastmoney.", "10jqka.", "wallstreetcn.", "36kr.", "zhihu.", "weixin.", "bing.", "google.")
OPAQUE_HOSTS = ("mp.weixin.qq.com", "zhuanlan.zhihu.com", "zhihu.com")
SEARCH_HOSTS = ("baidu.com", "bing.com", "google.com", "google.com.hk", "so.com", "sogou.com")
TYPED_HOSTS = {
    "independent": (
        # disclosure and its reprints
        "pdf.dfcfw.com", "notice.10jqka.com.cn", "xinsanban.eastmoney.com", "stock.finance.sina.com.cn", "cninfo.com.cn", "sse.com.cn", "szse.cn",
        # tender notices
        "ggzy.gov.cn", "zgggzy.com", "ccgp-ningxia.gov.cn", "qianlima.com", "bidcenter.com.cn", "jianyu360.cn", "gc-zb.com", "jrzb.cn", "xjygcg.com", "hbbidcloud.cn",
        # media
        "36kr.com", "sohu.com", "163.com", "qq.com", "sina.com.cn", "sina.cn", "shobserver.com", "jfdaily.com", "thepaper.cn", "cb.com.cn", "xinhuanet.com", "news.cn", "stdaily.com", "eastmoney.com", "jrj.com.cn", "pedaily.cn",
        "iyiou.com", "donews.com", "ebrun.com", "oeeee.com", "nfnews.com", "xhby.net", "chinadaily.com.cn", "china.com", "chinapp.net.cn", "people.com.cn", "cctv.com", "cri.cn", "rednet.cn", "zhiding.cn", "mpaypass.com.cn", "foodmate.com.cn",
        "investorscn.com", "icloudnews.net", "shaqiu.cn", "pop136.com", "chinapost.com.cn", "jcaizz.com", "gssk.cn", "microbell.com", "zhiliaobiaoxun.com", "jiemian.com", "tidenews.com.cn", "iheima.com", "vcbeat.top", "xueqiu.com", "leiphone.com",
    ),
    "related": (
        # registers with fields that companies fill in
        "qcc.com", "tianyancha.com", "aiqicha.baidu.com", "qixin.com", "qizhidao.com", "chacewang.com", "baike.baidu.com", "leshanvc.com",
        # projects' own pages
        "pitchhub.36kr.com", "data.iyiou.com",
        # job boards
        "zhipin.com", "liepin.com", "zhaopin.com", "jobui.com",
        # marketplaces
        "marketplace.huaweicloud.com", "startup.aliyun.com", "cloud.tencent.com", "ow.dingtalk.com", "1688.com",
        # members of associations
        "aii-alliance.org", "zhinengxiehui.com", "czaiia.com", "saiia.org.cn", "ahnpo.cn", "szaicx.com", "smartcity.team",
    ),
}
GRADE_RANK = {"statutory": 3, "independent": 2, "self": 1, "unverified": 0}


_SPECIAL = r"(?i)^(https?|ftp|wss?):[/\\]*([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _ascii_host(host: Column) -> Column:
    """A host in lower case, escapes read, labels beyond ASCII in Punycode (by java.net.IDN, inside the JVM)."""
    plain = F.lower(F.when(F.contains(host, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host))
    kept = F.replace(plain, F.lit("ß"), F.lit("\u0001"))  # the old rules would make it ss
    puny = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain)
    return F.when(F.octet_length(plain) == F.length(plain), plain).when(F.contains(kept, F.lit("\u0001")), plain).otherwise(F.coalesce(puny, plain))


def _escaped_path(path: Column) -> Column:
    """A path with blanks, quotes, angle brackets, backquotes, braces and all beyond ASCII as escapes of their UTF-8."""
    each = F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)))
    done = F.array_join(F.transform(each, lambda c: F.when(c.rlike(r"[^!-~]|[\"<>`{}]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(path.rlike(r"[^!-~]|[\"<>`{}]"), done).otherwise(path)


def _walked(path: Column) -> Column:
    """A path without dot segments, escaped ones too; backslashes are slashes."""
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e)(\.|%2e)$"
    steps = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]")
    made = F.aggregate(steps, F.lit(""), lambda acc, s: F.when(s.rlike(two), F.regexp_replace(acc, "/[^/]*$", "")).when(s.rlike(one), acc).otherwise(F.concat(acc, F.lit("/"), s)))
    last = F.element_at(steps, -1)
    whole = F.when(last.rlike(one) | last.rlike(two), F.concat(made, F.lit("/"))).otherwise(made)
    return F.when(path.rlike(r"(?i)[\\]|(^|/)(\.|%2e)"), whole).when(path == "", "/").otherwise(path)


def _query_parts(query: Column) -> Column:
    """The parameters that do not track, read and written again as forms write them."""
    read = lambda t: F.try_url_decode(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"))
    parts = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(read(F.regexp_extract(p, r"^([^=]*)", 1)).alias("n"), read(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v")))
    return F.transform(F.filter(parts, lambda p: ~p["n"].isin(*TRACKING)), lambda p: F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"])))


def canonical_url(url: Column) -> Column:
    """An address as a URL parser writes it, without fragment and tracking parameters; the others keep their order.

    Scheme and host are in lower case, hosts beyond ASCII in Punycode, a missing path is /, a
    scheme's own port goes, dot segments are walked, and paths are escaped where they must be.
    Parameters are read and written again: an escape that need not be one goes, a blank is +, a
    name without a value gets its =. Tabs and line breaks within and blanks around the address are
    dropped. Numbers as hosts are left as they are; so is what is no http, ftp or ws address.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    part = lambda k: F.regexp_extract(bare, _SPECIAL, k)
    scheme = F.lower(part(1))
    user, place = F.regexp_extract(part(2), r"^(.*@)", 1), F.regexp_replace(part(2), r"^.*@", "")
    host, port = _ascii_host(F.regexp_replace(place, r":[0-9]*$", "")), F.regexp_replace(F.regexp_extract(place, r":([0-9]*)$", 1), "^0+(?=[0-9])", "")
    own = F.when(scheme.isin("http", "ws"), "80").when(scheme.isin("https", "wss"), "443").otherwise("21")
    port = F.when((port == "") | (port == own), "").otherwise(F.concat(F.lit(":"), port))
    found = _query_parts(part(4))
    query = F.when(F.size(found) > 0, F.concat(F.lit("?"), F.array_join(found, "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), user, host, port, _escaped_path(_walked(part(3))), query)
    return F.when((scheme == "") | (place == ""), F.regexp_extract(bare, r"^([^#]*)", 1)).otherwise(whole)


def with_host(url: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(host of url), with the host worked out once however often the rule asks for it."""
    return F.element_at(F.transform(F.array(host_of(url)), rule), 1)


def host_of(url: Column) -> Column:
    """The lower-cased host, in Punycode where it goes beyond ASCII; empty where there is none."""
    beyond = F.octet_length(url) > F.length(url)
    told = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.trim(url), _SPECIAL, 2), r"^.*@", ""), r":[0-9]*$", "")
    odd = F.when(beyond & ~told.rlike(r"[\s<>^|%]"), _ascii_host(told))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), odd, F.lit(""))


def under(host: Column, names) -> Column:
    """Whether the host is one of the names or a subdomain of one."""
    out = host.isin(*names)
    for name in names:
        out = out | F.endswith(host, F.lit("." + name))
    return out


def holds(host: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(host, F.lit(part))
    return out


def source_grade(url: Column, statutory=STATUTORY_HOSTS, own=SELF_PARTS, independent=INDEPENDENT_PARTS) -> Column:
    return with_host(
        url,
        lambda host: (
            F.when(host == "", "unverified")
            .when(under(host, statutory), "statutory")
            .when(holds(host, own), "self")
            .when(F.endswith(host, F.lit(".gov.cn")) | holds(host, independent), "independent")
            .otherwise("self")
        ),
    )


def ceiling_grade(urls: Column, **rules) -> Column:
    """The best grade of an array of URLs, independent at most; unverified without any."""
    ranks = F.transform(urls, lambda u: grade_rank(source_grade(u, **rules)))
    best = F.least(F.coalesce(F.array_max(ranks), F.lit(0)), F.lit(2))
    return F.element_at(F.array(F.lit("unverified"), F.lit("self"), F.lit("independent")), (best + 1).cast("int"))


def grade_rank(grade: Column) -> Column:
    out = F.lit(0)
    for name, rank in GRADE_RANK.items():
        out = F.when(grade == name, rank).otherwise(out)
    return out


def audit_grade(url: Column, typed: dict[str, tuple[str, ...]] = TYPED_HOSTS, opaque=OPAQUE_HOSTS) -> Column:
    """independent, related or unknown: structure first, then opaque platforms, then the longest host rule, then root paths."""
    text = F.trim(F.coalesce(url, F.lit("")))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(text, F.lit("PATH")), F.lit("")), "/+$", "")
    rules = sorted(((name, kind) for kind, names in typed.items() for name in names), key=lambda r: len(r[0]))

    def by_rule(host: Column) -> Column:
        hit = F.lit(None).cast("string")
        for name, kind in rules:
            hit = F.when(under(host, (name,)), kind).otherwise(hit)
        return F.when(under(host, opaque), "unknown").otherwise(hit)

    def graded(full: Column) -> Column:
        host = F.regexp_replace(F.regexp_replace(full, r"^www\.", ""), r"^m\.", "")
        return (
            F.when(~text.rlike(r"^https?://[^\s（）\"']+$") | (full == ""), "unknown")
            .when(full.rlike(r"\.gov\.cn$|\.gov$|\.edu\.cn$"), "independent")
            .otherwise(F.coalesce(F.element_at(F.transform(F.array(host), by_rule), 1), F.when(path.isin("", "/index.html"), "related").otherwise("unknown")))
        )

    return with_host(text, graded)


def is_weak_source(url: Column) -> Column:
    """No address on the web, a search engine, or a page of search results: a path part "search" with a term q."""
    results = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(r"(?i)(^|/)search(/|$)") & (F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("q")), F.lit("")) != "")
    return ~F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://") | with_host(url, lambda host: (host == "") | under(host, SEARCH_HOSTS)) | results


def source_hint(url: Column) -> Column:
    return with_host(url, lambda host: F.when(host == "", "none").when(under(host, DISCLOSURE_HOSTS), "disclosure").when(holds(host, AGGREGATOR_PARTS), "aggregator").otherwise("other"))


def combined_grade(urls: Column, typed: dict[str, tuple[str, ...]] = TYPED_HOSTS, opaque=OPAQUE_HOSTS) -> Column:
    """The audit grade of an array of URLs: independent before related before unknown."""
    grades = F.transform(urls, lambda u: audit_grade(u, typed, opaque))
    return F.when(F.array_contains(grades, "independent"), "independent").when(F.array_contains(grades, "related"), "related").otherwise("unknown")


def sanitized_source_type(told: Column, url: Column, human: Column, current: Column) -> Column:
    """The kind of source as told, if it may stand: independent only for disclosure hosts, internal only with a person named."""
    kind, host = F.lower(F.trim(F.coalesce(told, F.lit("")))), host_of(url)
    fallback = F.coalesce(F.nullif(F.trim(current), F.lit("")), F.lit("related"))
    return (
        F.when((kind == "independent") & under(host, DISCLOSURE_HOSTS), "independent")
        .when(kind == "independent", "related")
        .when((kind == "internal") & (F.trim(F.coalesce(human, F.lit(""))) == ""), fallback)
        .when(kind.isin("related", "unknown", "internal"), kind)
        .otherwise(fallback)
    )


def is_private_address(address: Column) -> Column:
    """Whether an IP address, as text, is one that must not be fetched; text that is none counts as one."""
    v4 = F.regexp_replace(F.lower(address), "^::ffff:", "")
    part = lambda k: F.regexp_extract(v4, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    a, b = part(1), part(2)
    is4 = a.isNotNull() & (F.greatest(a, b, part(3), part(4)) <= 255)
    inside = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
    )
    is6 = F.contains(address, F.lit(":")) & address.rlike(r"^[0-9A-Fa-f:.]+$")
    return F.when(is4, inside).when(is6, address.rlike("(?i)^(::1$|::$|fc|fd|fe8|fe9|fea|feb)")).otherwise(True)


def fetch_refusal(url: Column) -> Column:
    """Why an address must not be fetched: unreadable, protocol, credentials or internal; null if it may.

    Names are not resolved: what they resolve to goes through is_private_address.
    """
    host, user = host_of(url), F.try_parse_url(url, F.lit("USERINFO"))
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    literal = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(bare, F.lit(":"))
    return (
        F.when(~F.coalesce(url, F.lit("")).rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "unreadable")
        .when(~url.rlike("(?i)^https?:"), "protocol")
        .when(host == "", "unreadable")
        .when(F.coalesce(user, F.lit("")) != "", "credentials")
        .when((bare == "localhost") | (literal & is_private_address(bare)), "internal")
    )
