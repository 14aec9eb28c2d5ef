"""References of pages made absolute, as RFC 3986 (5.2) resolves them, and the documents a filing points to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the expression of RFC 3986, appendix B; groups 1 to 9 are its parts.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
HREF = r"""(?i)href\s*=\s*["']([^"']*)["']"""


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def parts(url: Column) -> Column:
    """scheme, authority, path, query and fragment; what is not there is null, a path is never null."""
    got = lambda whole, inner: F.when(F.regexp_extract(url, PARTS, whole) != "", F.regexp_extract(url, PARTS, inner))
    return F.struct(got(1, 2).alias("scheme"), got(3, 4).alias("authority"), F.regexp_extract(url, PARTS, 5).alias("path"), got(6, 7).alias("query"), got(8, 9).alias("fragment"))


def without_dots(path: Column) -> Column:
    """The path with `.` and `..` segments taken away; `..` above the root stays at the root."""

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    def clean(segments: Column) -> Column:
        rest = F.slice(segments, F.lit(2), F.size(segments))
        kept = F.aggregate(rest, F.slice(segments, 1, 1), step)
        ends = F.element_at(segments, -1).isin(".", "..")
        return F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))

    return F.when(F.startswith(path, F.lit("/")), _let(F.split(path, "/"), clean)).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """The absolute address of a reference on the page at base; null if either is. base is absolute."""

    def of(b: Column, r: Column) -> Column:
        own = r["scheme"].isNotNull()
        host = own | r["authority"].isNotNull()
        rooted = F.startswith(r["path"], F.lit("/"))
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], "[^/]*$", ""), r["path"]))
        path = F.when(host | rooted, without_dots(r["path"])).when(r["path"] == "", b["path"]).otherwise(_let(merged, without_dots))
        query = F.when(host | (r["path"] != "") | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
        authority = F.when(host, r["authority"]).otherwise(b["authority"])
        mark = lambda before, x: F.coalesce(F.concat(F.lit(before), x), F.lit(""))
        scheme = F.coalesce(r["scheme"], b["scheme"])
        return F.concat(F.coalesce(F.concat(scheme, F.lit(":")), F.lit("")), mark("//", authority), path, mark("?", query), mark("#", r["fragment"]))

    r = F.trim(reference)
    return F.when(base.isNotNull() & reference.isNotNull(), _let(parts(base), lambda b: _let(parts(r), lambda p: of(b, p))))


def hrefs(html: Column) -> Column:
    """What a page's links say, in order; null pages have none."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), F.array().cast("array<string>"))


def xml_documents(html: Column, url: Column, site: str = "https://www.sec.gov") -> Column:
    """The .xml files a filing's page points to, each once, in order: absolute as they are, from the root on `site`,
    others in the folder named like the page. Without any, the four names that filings of
    the address's accession number go by; without that number none."""
    folder = F.concat(F.regexp_replace(url, r"\.[^.]*$", ""), F.lit("/"))
    named = F.filter(hrefs(html), lambda h: F.endswith(F.lower(h), F.lit(".xml")))
    full = F.transform(named, lambda h: F.when(F.startswith(h, F.lit("http")), h).when(F.startswith(h, F.lit("/")), F.concat(F.lit(site), h)).otherwise(F.concat(folder, h)))
    number = F.regexp_extract(url, r"(\d{10}-\d{2}-\d{6})", 1)
    names = F.array(F.concat(number, F.lit(".xml")), F.concat(F.regexp_replace(number, "-", ""), F.lit(".xml")), F.lit("primary_doc.xml"), F.lit("form4.xml"))
    guessed = F.when(number != "", F.transform(names, lambda n: F.concat(folder, n))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(full)
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(guessed, F.array().cast("array<string>")))
