"""Link normalisation, link filters and providers, driven by a rule table."""

from __future__ import annotations

from dataclasses import dataclass
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagemill.functions import text as X


@dataclass(frozen=True)
class LinkRule:
    """A provider's links: what one holds, what a job link holds besides, and what it is written as: `$id` is the first group of
    `number`, `$path` the link's path."""

    provider: str
    named: tuple[str, ...]
    job: tuple[str, ...]
    canonical: str | None = None
    number: str | None = None

    def holds(self, parts: tuple[str, ...]) -> str:
        return "^" + "".join(f"(?=.*(?:{p}))" for p in parts)


_RESULTS = r"(?:careers\.google\.com|google\.com)/.+/jobs/results/\d+"
_CLOUD = r"\.fa\.ocs\.oraclecloud\.(?:com|eu)"
#: Hosts, paths and names of the providers.
RULES: tuple[LinkRule, ...] = (
    LinkRule("LinkedIn", (r"linkedin\.com",), (r"linkedin\.com/(?:comm/)?jobs/view/",), "https://www.linkedin.com/jobs/view/$id", r"linkedin\.com/(?:comm/)?jobs/view/(\d+)"),
    LinkRule("The Hub", (r"thehub\.io",), (r"thehub\.io/jobs/[0-9a-f]{12,}",), "https://thehub.io/jobs/$id", r"thehub\.io/jobs/([0-9a-f]{12,})"),
    LinkRule("Google Careers", (r"careers\.google\.com|google\.com/about/careers/applications/jobs/results/",), (_RESULTS,), "https://careers.google.com$path"),
    LinkRule("Jobindex", (r"jobindex\.dk",), (r"jobindex\.dk", r"jobid=|/jobannonce/[hr]\d+|/bruger/dine-job/[hr]\d+")),
    LinkRule("Nordea", (r"careers\.nordea\.com",), (r"careers\.nordea\.com", "/job/"), "https://careers.nordea.com$path"),
    LinkRule("Novo Nordisk", (r"careers\.novonordisk\.com",), (r"careers\.novonordisk\.com", "/job/"), "https://careers.novonordisk.com$path"),
    LinkRule("Oracle CX", (_CLOUD, "/candidateexperience/"), (_CLOUD, "/candidateexperience/", r"/job/\d+")),
    LinkRule("Demant", (r"careers\.demant\.com",), (r"careers\.demant\.com", "/job/")),
    LinkRule("Danfoss", (r"jobs\.danfoss\.com",), (r"jobs\.danfoss\.com", "/job/")),
    LinkRule("Teradyne", (r"jobs\.teradyne\.com",), (r"jobs\.teradyne\.com", "/job/"), "https://jobs.teradyne.com$path"),
    LinkRule("NTT DATA Business Solutions", (r"careers\.nttdata-solutions\.com",), (r"careers\.nttdata-solutions\.com", "/job/")),
    LinkRule("Getinge", (r"careers\.getinge\.com",), (r"careers\.getinge\.com", "/job/")),
    LinkRule("Tetra Pak", (r"jobs\.tetrapak\.com",), (r"jobs\.tetrapak\.com", r"/job/[^/]+/\d+"), "http://jobs.tetrapak.com$path"),
)


def host(link: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(link, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]+)", 1))


def path(link: Column) -> Column:
    """The path, without the parameters of its last step."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(link, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")


def provider(link: Column, rules: tuple[LinkRule, ...] = RULES) -> Column:
    low = F.lower(F.coalesce(link, F.lit("")))
    other = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(link, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    named = [F.when(low.rlike(rule.holds(rule.named)), rule.provider) for rule in rules]
    return F.coalesce(*named, F.nullif(other, F.lit("")), F.lit("Unknown"))


def is_job_link(link: Column, rules: tuple[LinkRule, ...] = RULES) -> Column:
    """One pattern asks all rules, so that the link is looked at once."""
    return F.coalesce(F.lower(link).rlike("|".join(rule.holds(rule.job) for rule in rules)), F.lit(False))


def normalize(link: Column, rules: tuple[LinkRule, ...] = RULES) -> Column:
    """A provider's canonical form; else scheme, host and path without a closing slash. A Jobindex link that only tracks is empty."""

    def written(v: Column) -> Column:
        link, low, way = v["link"], v["low"], v["way"]
        out: list[Column] = []
        for rule in rules:
            if rule.canonical and rule.number:
                out.append(_numbered(rule, F.regexp_extract(low, rule.number, 1)))
            elif rule.canonical:
                out.append(F.when(low.rlike(rule.holds(rule.job)) & (way != ""), F.rtrim(F.concat(F.lit(rule.canonical.replace("$path", "")), way), F.lit("/"))))
            elif rule.provider == "Jobindex":
                number = F.nullif(jobindex_id(link), F.lit(""))
                here = F.concat(F.lit("https://www.jobindex.dk/jobannonce/"), number)
                out.append(F.when(low.contains("jobindex.dk"), F.coalesce(here, F.when(link.rlike(r"[?&]ttid=[^&#]"), ""))))
            elif rule.provider == "Oracle CX":
                fits = F.lower(v["site"]).rlike(_CLOUD) & F.lower(way).contains("/candidateexperience/") & F.lower(way).rlike(r"/job/\d+/?$")
                out.append(F.when(fits, F.rtrim(F.concat(F.lit("https://"), F.regexp_replace(v["site"], ":(443|80)$", ""), way), F.lit("/"))))
        plain = F.when((v["scheme"] != "") & (v["site"] != ""), F.concat(F.lower(v["scheme"]), F.lit("://"), v["site"], way)).otherwise(link)
        return F.coalesce(*out, F.rtrim(plain, F.lit("/")))

    form = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)"
    parts = lambda x: F.struct(x.alias("link"), F.lower(x).alias("low"), path(x).alias("way"), F.regexp_extract(x, form, 1).alias("scheme"), F.regexp_extract(x, form, 2).alias("site"))
    return X.let(X.let(F.trim(F.coalesce(link, F.lit(""))), parts), written)


def _numbered(rule: LinkRule, found: Column) -> Column:
    return F.when(found != "", F.concat(F.lit(rule.canonical.replace("$id", "")), found))


def query_value(link: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.try_url_decode(F.regexp_extract(F.coalesce(link, F.lit("")), rf"[?&]{name}=([^&#]*)", 1)), F.lit("")))


def is_reference_link(raw: Column, normalized: Column) -> Column:
    """A LinkedIn link that only refers to the mail's own posting: its reference number is that of its path."""
    found = F.coalesce(F.nullif(query_value(raw, "referenceJobId"), F.lit("")), query_value(raw, "referencejobid"))
    return F.lower(F.coalesce(raw, F.lit(""))).contains("linkedin.com") & found.rlike(r"^\d+$") & (F.regexp_extract(F.lower(normalized), r"linkedin\.com/(?:comm/)?jobs/view/(\d+)", 1) == found)


def jobindex_id(link: Column) -> Column:
    """The listing's id out of the path, or else out of the query; empty if there is none."""
    low = F.lower(F.coalesce(link, F.lit("")))
    forms = (r"/jobannonce/([hr]\d+)", r"/bruger/dine-job/([hr]\d+)", r"[?&]jobid=([hr]\d+)(?:[&#]|$)", r"[?&]t=([hr]\d+)(?:[&#]|$)")
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in forms], F.lit(""))


def unescape(c: Column) -> Column:
    """A text with its HTML entities resolved, once: numbers, and the names of HTML 4."""
    # The names and signs come from Python's table.
    names = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))])

    def resolved(part: Column) -> Column:
        code, rest = F.regexp_extract(part, r"(?s)^([^;]{1,10});(.*)$", 1), F.regexp_extract(part, r"(?s)^([^;]{1,10});(.*)$", 2)
        digits = F.regexp_extract(code, r"^#([0-9]{1,7})$", 1)
        hexed = F.when(digits != "", F.conv(digits, 10, 16)).otherwise(F.regexp_extract(code, r"^#[xX]([0-9A-Fa-f]{1,6})$", 1))
        number = F.conv(hexed, 16, 10).cast("long")
        fits = (hexed != "") & number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(fits, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, code))
        return F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), part))

    parts = F.split(c, "&", -1)
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolved), ""))
    return F.when(c.contains("&"), joined).otherwise(c)


def unwrap_tracker(link: Column) -> Column:
    """The target that a mail tracker's link carries as base64 JSON in its query's `p`; the link itself if it carries none."""
    code = F.rtrim(F.translate(F.regexp_extract(F.coalesce(link, F.lit("")), r"[?&]p=([A-Za-z0-9_\-=%/]+)", 1), "-_", "+/"), F.lit("="))
    padded = X.let(code, lambda c: F.concat(c, F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(c), F.lit(4)))))
    outer = F.try_to_binary(padded, F.lit("base64")).cast("string")
    # Signs that stand for themselves, to a decoder of forms: a plus, and a percent sign before no number.
    written = F.regexp_replace(F.replace(F.trim(F.get_json_object(F.get_json_object(outer, "$.p"), "$.url")), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    target = F.replace(unescape(F.try_url_decode(written)), F.lit("\\/"), F.lit("/"))
    return F.when(F.lower(link).contains("mandrillapp.com/track/click/"), F.coalesce(F.nullif(target, F.lit("")), link)).otherwise(link)


def links_in(text: Column) -> Column:
    """The http links of a text, without closing punctuation, the first of each."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>'\"]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[).,;\]]+$", "")))


def hrefs_in(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
