"""URLs: canonical form, host, specificity, kind of page (FN-U01 .. FN-U10). NULL stays NULL unless stated."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys of search pages.
SEARCH_KEYS = ("q", "query", "search", "keywords", "zoekwoord", "text", "searchterm", "suchbegriff", "k")
# Path parts of search and stock pages; whole paths, and parts anywhere in the path.
STOCK_PATHS = ("/gebrauchtwagen", "/fahrzeuge", "/occasions", "/stock", "/cars", "/autos")
SEARCH_PARTS = ("/search", "/zoeken", "/suche", "/suchen", "/recherche", "/ricerca", "/buscar", "/q/", "/l/", "/lst", "/results", "/resultaten", "/anzeigen", "/inventory", "/aanbod")
# Path parts of the page of one item.
DETAIL_PARTS = (
    "/v/", "/listing/", "/inserat", "/angebot/", "/annonce", "/annuncio", "/anuncio", "/vehicle/", "/fahrzeug/", "/ad/", "/item/", "/a/", "/detail", "/oferta", "/occasion/", "/used-car",
    "/voiture/", "/coche/", "/auto/", "/pkw/", "/gebrauchtwagen/", "/fahrzeuge/",
)
# Fixed value: query keys that only track where a visitor came from.
TRACKING = r"^(utm_|fbclid|gclid|mc_|ref$|source$)"


_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.trim(url), pattern, 1)


def scheme(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://")), F.lit("")), F.lit("https"))


def netloc(url: Column) -> Column:
    """Lower-case host with its port, without ``www.``; '' where there is none. URLs without a scheme are accepted."""
    return F.regexp_replace(F.lower(_part(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)")), r"^www\.", "")


def domain(url: Column) -> Column:
    """FN-U04: host without port and ``www.``; '' for empty input, NULL for NULL."""
    return F.regexp_replace(netloc(url), r":\d*$", "")


def path(url: Column) -> Column:
    return _part(url, _PATH)


def query(url: Column) -> Column:
    return _part(url, _QUERY)


def fragment(url: Column) -> Column:
    return _part(url, r"#(.*)$")


def normalize(url: Column) -> Column:
    """FN-U03: host lower case without ``www.``; tracking and blank parameters dropped, the rest decoded, sorted by key and value and encoded anew; no fragment, no trailing slash; an empty path is '/'. Empty text stays as it is, and so does a query whose escapes can't be decoded."""
    pairs = F.filter(F.split(query(url), "&"), lambda kv: kv.rlike(r"^[^=]+=.+"))
    # names are compared decoded; url_encode writes a space as + and keeps letters, digits and .-*_ (a tilde is kept, a star encoded, as in form encoding of URLs)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    code = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    named = F.transform(pairs, lambda kv: F.struct(plain(F.regexp_extract(kv, r"^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(kv, r"^[^=]*=(.*)$", 1)).alias("v")))
    chosen = F.array_sort(F.filter(named, lambda x: ~F.lower(x["k"]).rlike(TRACKING)))
    kept = F.array_join(F.transform(chosen, lambda x: F.concat(code(x["k"]), F.lit("="), code(x["v"]))), "&")
    p = F.regexp_replace(F.regexp_replace(path(url), r";[^/]*$", ""), r"/+$", "")
    whole = F.concat(scheme(url), F.lit("://"), netloc(url), F.when(p == "", "/").otherwise(p), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.trim(url) == "", url).otherwise(whole)


def resolve(base: Column, href: Column) -> Column:
    """FN-U09: ``href`` as seen from the page ``base``: absolute, scheme-less, from the root, relative with . and .. or a query or fragment only. NULL or '' gives the base."""
    h, root = F.trim(href), F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"//([^/?#]*)", 1))
    without = F.regexp_replace(base, r"#.*$", "")
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), h)
    whole = F.when(h.startswith("/"), h).otherwise(joined)
    tail = F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_extract(whole, r"^/?([^?#]*)", 1), "/")
    walk = F.aggregate(steps, F.array().cast("array<string>"), lambda at, x: F.when(x == ".", at).when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x))))
    closing = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(walk) > 0), "/").otherwise("")
    local = F.concat(root, F.lit("/"), F.array_join(walk, "/"), closing, tail)
    return (
        F.when(href.isNull() | (h == ""), base)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("#"), F.concat(without, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(without, r"\?.*$", ""), h))
        .otherwise(local)
    )


def is_specific(url: Column) -> Column:
    """FN-U05: has a path or a query. NULL and '' are not specific."""
    return F.coalesce((F.regexp_replace(path(url), "/", "") != "") | (query(url) != ""), F.lit(False))


def _contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


#: Kinds of pages as a table: the first line that holds decides. A line is (kind, all or any of the tests, tests); a test is (part, relation, values). ``quality`` and ``kind_of`` both read it.
PAGE_RULES = (
    ("HOMEPAGE", all, (("path", "is", ("",)), ("query", "is", ("",)))),
    ("SEARCH_PAGE", any, (("keys", "has", SEARCH_KEYS), ("url", "contains", ("#q:",)), ("folder", "is", STOCK_PATHS), ("closed", "contains", SEARCH_PARTS), ("closed", "matches", (r"/(?:fahrzeuge|gebrauchtwagen|auto)/$",)))),
    ("EXACT_DETAIL", any, (("closed", "contains", DETAIL_PARTS), ("path", "matches", (r"\d{5,}",)))),
    # a slug behind a folder, or three folders deep
    ("LIKELY_DETAIL", any, (("path", "matches", (r"[^/]/+[^/]*-[^/]*$", r"[^/]/+[^/]{13,}$", r"[^/]+/+[^/]+/+[^/]+")),)),
)


def _parts(url: Column) -> dict[str, Column]:
    p = F.regexp_replace(path(url), r"/+$", "")
    folder = F.concat(F.lit("/"), F.regexp_replace(F.lower(p), r"^/+|/+$", ""))
    keys = F.transform(F.filter(F.split(F.lower(query(url)), "&"), lambda kv: kv.rlike(r"^[^=]+=.+")), lambda kv: F.regexp_extract(kv, r"^([^=]*)", 1))
    return {"url": F.lower(url), "path": p, "query": query(url), "keys": keys, "folder": folder, "closed": F.concat(folder, F.lit("/"))}


def quality(url: Column) -> Column:
    """FN-U07: EXACT_DETAIL, LIKELY_DETAIL, SEARCH_PAGE, HOMEPAGE or UNKNOWN by PAGE_RULES; search signs win over detail signs. NULL and '' are UNKNOWN."""
    # the parts are worked out once a row, however many rules name them
    parts = F.struct(*[c.alias(k) for k, c in _parts(url).items()])
    return F.get(F.transform(F.array(parts), lambda p: _judged(url, p)), F.lit(0))


def _judged(url: Column, part: Column) -> Column:
    relation = {
        "is": lambda c, vs: c.isin(*vs), "has": lambda c, vs: F.arrays_overlap(c, F.array(*[F.lit(v) for v in vs])), "contains": _contains_any,
        "matches": lambda c, vs: reduce(lambda a, b: a | b, [c.rlike(v) for v in vs]),
    }
    out = F.when(url.isNull() | (F.trim(url) == ""), "UNKNOWN")
    for kind, how, tests in PAGE_RULES:
        out = out.when(reduce((lambda a, b: a & b) if how is all else (lambda a, b: a | b), [relation[r](part[p], vs) for p, r, vs in tests]), kind)
    return out.otherwise("UNKNOWN")


def kind_of(url: str | None) -> str:
    """``quality`` of one URL outside of Spark, for links met while a page's tree is walked."""
    whole = (url or "").strip()
    if not whole:
        return "UNKNOWN"
    p = re.search(_PATH, whole)[1].rstrip("/")
    q = (re.search(_QUERY, whole) or ("", ""))[1]
    folder = "/" + p.lower().strip("/")
    part = {"url": whole.lower(), "path": p, "query": q, "keys": {kv.split("=")[0] for kv in q.lower().split("&") if re.match(r"[^=]+=.", kv)}, "folder": folder, "closed": folder + "/"}
    relation = {"is": lambda x, vs: x in vs, "has": lambda x, vs: any(v in x for v in vs), "contains": lambda x, vs: any(v in x for v in vs), "matches": lambda x, vs: any(re.search(v, x) for v in vs)}
    return next((kind for kind, how, tests in PAGE_RULES if how(relation[r](part[p], vs) for p, r, vs in tests)), "UNKNOWN")


def is_detail(url: Column) -> Column:
    """FN-U08."""
    return quality(url).isin("EXACT_DETAIL", "LIKELY_DETAIL")


def pick_canonical(candidates: Column, dealer: Column, aggregators: tuple[str, ...] = ()) -> Column:
    """FN-U06: of an array of URLs the first specific one on the dealer's domain, else the first specific one off the aggregators, else the first specific one, else the first. NULL and '' entries are skipped."""
    urls = F.filter(candidates, lambda u: u.isNotNull() & (u != ""))
    off = lambda u: reduce(lambda a, b: a & b, [~domain(u).contains(x) for x in aggregators], F.lit(True))
    return F.coalesce(
        F.get(F.filter(urls, lambda u: is_specific(u) & (domain(u) == dealer)), F.lit(0)),
        F.get(F.filter(urls, lambda u: is_specific(u) & off(u)), F.lit(0)),
        F.get(F.filter(urls, is_specific), F.lit(0)),
        F.get(urls, F.lit(0)),
    )


def best_external(*urls: Column) -> Column:
    """FN-U10: the first of the URLs that is the page of one item."""
    return F.coalesce(*[F.when(is_detail(u), u) for u in urls])


def content_hash(*parts: Column) -> Column:
    """FN-U01: sha-256 over each part, trimmed and lower case, each followed by the unit separator; NULL counts as ''."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.lower(F.trim(F.coalesce(p, F.lit("")))), F.lit("\x1f"))]), 256)


def stable_id(*parts: Column) -> Column:
    """FN-U02: the first 20 hexadecimal digits of the content hash."""
    return F.substring(content_hash(*parts), 1, 20)
