"""URLs, links, page identities and listing records over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.functions.text import clean_text, slugify
from docketlens.functions.urls import canonical_url, url_host
from docketlens.operators import agency as A
from docketlens.operators import identity as I
from docketlens.operators.catalog import unify
from docketlens.operators.lifecycle import check_sources
from docketlens.plans.tables import pick, sql_pick, table
from docketlens.session import written_once
from docketlens.sources.pages import extract_elements, page_modified_dates, register_page_elements

CHECKED_AT = "2024-01-31T00:00:00.000Z"


def url_forms():
    """Variants of each page URL, so that every canonicalization rule occurs."""
    url = F.col("url")
    forms = [url, F.concat(url, F.lit("&utm_medium=x&b")), F.concat(F.regexp_replace(url, r"[?#].*", ""), F.lit("?b=2&a=1&B=%20x&a=%C3%A9#f")),
             F.concat(F.lit("  "), F.regexp_replace(url, r"[?#].*", ""), F.lit("//?gclid=1&q=a+b&q=A%zz&Source=1")),
             F.regexp_replace(url, "^(https?)://([^/]*)", "$1://$2:443")]
    chain = F.when(F.col("page_id") % 5 == 0, forms[0])
    for pos in range(1, 4):
        chain = chain.when(F.col("page_id") % 5 == pos, forms[pos])
    return chain.otherwise(forms[4])


def url_canonical(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", url_forms().alias("raw_url"))
    return pages.select("page_id", "raw_url", canonical_url(F.col("raw_url")).alias("canonical_url"))


def links_of(pages):
    """(page_id, url, pos, href, text) of every link of pages (page_id, url, html), as an HTML parser finds them."""
    found = extract_elements(pages, ("url",)).filter(F.col("kind") == "anchor")
    return found.select("page_id", "url", F.col("at").alias("pos"), F.col("hrefs")[0].alias("href"), clean_text(F.col("link_texts")[0]).alias("text"))


def links(spark, folder):
    # Written, as the queries read them more than once and parsing is the costly step.
    return written_once(links_of(table(spark, folder, "pages")), "page-links")


#: Markup beside that of the given pages, with the links it holds.
ODD_PAGES = [
    ("<p><a href=/1>x <a href='/2'>y</a></p>", [("/1", "x"), ("/2", "y")]),
    ("<p><a href='/open'>never closed", [("/open", "never closed")]),
    ("<a title=\"a>b\" href=\"/quoted\">q</a><!-- <a href='/no'>no</a> --><a name=here>none</a>", [("/quoted", "q")]),
    ("<a href='/a&#47;b?x=1&amp;y=2'>It&#8217;s &eacute;t&eacute;&mdash;now&nbsp;!</a>", [("/a/b?x=1&y=2", "It\u2019s \u00e9t\u00e9\u2014now !")]),
    ("<a href=/s>before<script>var a = '<a href=/t>t</a>';</script><style>a{}</style> after</a><area href=/area>", [("/s", "before after")]),
    ("<div>" * 5000 + "<a class=deep href=/deep>deep</a>", [("/deep", "deep")]),
]
ODD_URL = "https://odd.example.org/dir/page"
ODD_ID = 10**15


def page_links(spark, folder):
    odd = spark.createDataFrame([(ODD_ID + i, ODD_URL, html) for i, (html, _) in enumerate(ODD_PAGES)], "page_id bigint, url string, html string")
    pages = table(spark, folder, "pages").select("page_id", "url", "html").unionByName(odd)
    return links_of(pages).select(
        "page_id", "pos", "href", "text", canonical_url(F.col("href"), F.col("url")).alias("link_url")
    )


def identities(spark, folder):
    """Every link of every page as a record, so that pages linking alike merge."""
    rows = links(spark, folder)
    return rows.select(
        I.identity_key(
            F.lit("link"), F.when(F.col("pos") % 3 == 0, F.lit(None)).otherwise(F.col("href")),
            F.when(F.col("pos") % 3 == 1, F.lit(None)).when(F.col("pos") % 6 == 0, F.lit(None))
            .otherwise(F.concat(F.lit("https://links.example.org"), F.col("href"), F.lit("/?utm_source=a"))),
            F.col("text"),
        ).alias("identity_key"),
        "page_id", "pos", "href",
        F.when(F.col("page_id") % 4 != 0, F.concat(F.col("text"), F.lit(" on "), url_host(F.col("url")))).otherwise("").alias("summary"),
        F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("string")).otherwise("").alias("eligibility"),
        F.when(F.col("page_id") % 2 == 0, F.col("text")).alias("benefit"),
        url_host(F.col("url")).alias("host"),
    )


def page_dedupe(spark, folder):
    order = [F.col("page_id"), F.col("pos")]
    return I.merge_records(identities(spark, folder).drop("host"), order)


def page_dedupe_members(spark, folder):
    return I.merged_members(
        identities(spark, folder),
        {"source_id": F.col("host"), "source_record_id": F.col("page_id").cast("string"),
         "provenance": F.concat_ws("|", "host", "href")},
    )


WORDINGS = [
    "Buyers of the heater need not write: no action is needed. We mailed $1,250.50 or $ 40 to each home",
    "Only consumers who are contacted may respond, by post. A share is $1,250.50 and again $1,250.50",
    "The claim window has closed.", "Submit a claim by mail.", "See the agency page.",
    "If you received a notice, claim form is open",
]
MONTHS = ["July 2026", "june 2025", "Junk 2024", "", "March  2024", "May 24"]
LISTING_URL = "https://agency.example.gov/enforcement/refunds"


def listing_source() -> A.ListingSource:
    """A listing source of the user's own, read by table headers."""
    return A.ListingSource(
        "example_refunds", "Example Agency", "EX", LISTING_URL, "active_refund_program",
        entry=lambda: (F.col("kind") == "row") & A.has_headers(r"refund\s*program", "^date$", "contact"),
        title=A.cell_title, href=A.first_href, summary=lambda: F.lit("Listed."),
        compensation=lambda: F.lit("Refund"), contact=lambda: F.when(A.cell(2) != "", A.cell(2)),
        program_date=lambda: A.month_date(A.cell(1)), accept=lambda: F.size("cells") >= 2,
    )


def listing_pages(spark, folder):
    """Each page's own links rendered as a refund-program table with a dated footer."""
    page = F.col("page_id")
    # The links of one page, each an element of its markup.
    anchors = links(spark, folder).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "href", "text"))).alias("anchors"))
    pages = table(spark, folder, "pages").select("page_id").join(anchors, "page_id", "left")
    rows = F.transform(
        F.coalesce("anchors", F.array().cast("array<struct<pos:int,href:string,text:string>>")),
        lambda a: F.concat(
            F.lit('<tr><td><a href="'), a["href"], F.lit('">'), a["text"], F.lit("</a></td><td>"),
            pick((page + a["pos"]) % len(MONTHS), MONTHS), F.lit("</td><td>"),
            pick((page * 5 + a["pos"]) % len(WORDINGS), WORDINGS), F.lit("</td>"),
        ),
    )
    footer = F.when(
        page % 2 == 0, F.concat(F.lit('<div><p>Page last  modified: <time datetime="2024-01-'), F.lpad((page % 28 + 1).cast("string"), 2, "0"), F.lit('">x</time></p></div>'))
    ).otherwise('<p>Posted <time datetime="2023-05-05">May</time></p>')
    return pages.select(
        "page_id",
        F.concat(
            F.lit("<main><table><thead><tr><th>Other</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>"
                  "<table><thead><tr><th>Refund  Program</th><th>Date</th><th>Contact Info</th></tr></thead><tbody>"),
            F.array_join(rows, "</tr>"), F.lit("</tbody></table>"), footer, F.lit("</main>"),
        ).alias("html"),
    )


def agency_listing(spark, folder):
    elements = written_once(extract_elements(listing_pages(spark, folder)), "page-elements")
    source = listing_source()
    entries = A.listing_entries(elements, source)
    records = A.agency_records(entries, source, CHECKED_AT, page_modified_dates(elements))
    amounts = F.array_join(F.transform("amounts", lambda a: F.concat_ws("=", a["raw"], a["value"].cast("decimal(18,2)").cast("string"))), ";")
    return records.select(
        "page_id", "record_id", "fingerprint", "source_record_id", "title", "program_url", "participation_mode",
        "window_status", "contact", "program_date", "page_modified", amounts.alias("amounts"),
    )


def listing_checks(spark, folder):
    """The listing's row counts against its minimum and parse share, beside a source that finds nothing."""
    elements = written_once(extract_elements(listing_pages(spark, folder)), "page-elements")
    counts = None
    for source in (listing_source(), A.distributions_source()):
        entries = A.listing_entries(elements, source)
        found = A.listing_counts(entries, A.agency_records(entries, source, CHECKED_AT), source)
        counts = found if counts is None else counts.unionByName(found)
    return check_sources(counts).select("source_id", "raw_rows", "parsed_rows", "status", "error")


_SEC_FOLDER = "/enforcement-litigation/distributions-harmed-investors"


def agency_pages(spark, folder):
    """(page_id, source_id, html): each page's own links in the markup of one of the three agencies."""
    page = F.col("page_id")
    anchors = links(spark, folder).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "href", "text"))).alias("anchors"))
    link = lambda a, folder="": F.concat(F.lit(f'<a href="{folder}'), a["href"], F.lit('">'), a["text"], F.lit("</a>"))
    worded = lambda a: pick((page * 5 + a["pos"]) % len(WORDINGS), WORDINGS)
    month = lambda a: pick((page + a["pos"]) % len(MONTHS), MONTHS)
    listed = lambda each: F.array_join(F.transform("anchors", each), "")
    table_rows = lambda cells: listed(lambda a: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells(a)], F.lit("</tr>")))
    refunds = F.concat(F.lit("<table><thead><tr><th>Refund program<th>Date<th>Contact</thead><tbody>"), table_rows(lambda a: [link(a), month(a), worded(a)]), F.lit("</tbody></table>"))
    payments = F.concat(
        F.lit('<div class="block"><h2 id="ongoing-cases">Ongoing</h2><table><tbody>'), table_rows(lambda a: [link(a), worded(a)]), F.lit("</tbody></table></div>")
    )
    items = listed(lambda a: F.concat(F.lit("<li>"), link(a, _SEC_FOLDER), F.lit(" "), worded(a), F.lit("</li>")))
    distributions = F.concat(F.lit(f'<a href="{_SEC_FOLDER}/archive-completed-distributions">Archive</a><ul>'), items, F.lit('</ul><a href="/about">About</a>'))
    footer = F.when(
        page % 2 == 0, F.concat(F.lit('<p>Last updated <time datetime="2024-01-'), F.lpad((page % 28 + 1).cast("string"), 2, "0"), F.lit('">January</time></p>'))
    ).otherwise("")
    ids = [s.source_id for s in agency_adapters()]
    html = F.when(page % 3 == 0, refunds).when(page % 3 == 1, payments).otherwise(distributions)
    return anchors.select("page_id", pick(page % 3, ids).alias("source_id"), F.concat(html, footer).alias("html"))


def agency_adapters():
    return [A.refund_source(), A.payments_source(), A.distributions_source(5)]


def _agency(spark, folder):
    """For each adapter its pages, entries and records; elements come from the table function, in SQL."""
    register_page_elements(spark)
    pages = written_once(agency_pages(spark, folder), "agency-pages")
    lateral = spark.sql("SELECT p.page_id, p.source_id, e.* FROM {pages} p, LATERAL page_elements(p.html) e", pages=pages)
    elements = written_once(lateral, "agency-elements")
    for source in agency_adapters():
        own = elements.filter(F.col("source_id") == source.source_id).drop("source_id")
        entries = A.listing_entries(own, source)
        yield source, pages.filter(F.col("source_id") == source.source_id), entries, A.agency_records(entries, source, CHECKED_AT, page_modified_dates(own))


def agency_page_checks(spark, folder):
    """Each page's row counts against its adapter's minimum and parse share."""
    counts = [A.page_counts(entries, records, pages, source) for source, pages, entries, records in _agency(spark, folder)]
    return check_sources(unify(*counts)).select("page_id", "source_id", "raw_rows", "parsed_rows", "status", "error")


def agency_source_records(spark, folder):
    """Records of the three adapters with their dates, what they reproduce of the page, and where they come from."""
    dates = F.array_join(F.transform("dates", lambda d: F.concat_ws(":", d["kind"], d["value"], d["precision"], d["raw"])), ";")
    return unify(*[records for *_, records in _agency(spark, folder)]).select(
        "page_id", "source_id", "record_id", "title", "program_url", "program_status", dates.alias("dates"),
        F.array_join("verification.confidence_scope", ",").alias("confidence_scope"), "verification.state", "action.label", F.col("action.url_role").alias("url_role"),
        F.col("provenance")[0]["record_url"].alias("record_url"), F.col("provenance")[0]["observed_at"].alias("observed_at"),
    )


def page_slugs(spark, folder):
    return links(spark, folder).select("page_id", "pos", slugify(F.col("text")).alias("slug"), clean_text(F.col("text")).alias("text"))


QUERIES = {
    "url_canonical": url_canonical,
    "page_links": page_links,
    "page_dedupe": page_dedupe,
    "page_dedupe_members": page_dedupe_members,
    "agency_records": agency_listing,
    "listing_checks": listing_checks,
    "page_slugs": page_slugs,
    "agency_page_checks": agency_page_checks,
    "agency_source_records": agency_source_records,
}

# ---- the same in SQL ----

_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def sql_clean(value: str) -> str:
    return f"trim(regexp_replace({value}, '{_WS}', ' ', 'g'))"


def sql_slug(value: str) -> str:
    return (
        f"substr(trim(regexp_replace(replace(lower(strip_accents({sql_clean(value)})), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), 1, 100)"
    )


def _sql_form(value: str) -> str:
    return f"replace(replace(replace(url_encode({value}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def _sql_decode(value: str) -> str:
    return f"(CASE WHEN regexp_matches({value}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN replace({value}, '+', ' ') ELSE url_decode(replace({value}, '+', ' ')) END)"


def sql_canonical(url: str) -> str:
    """Canonical form of an absolute URL without dot segments."""
    bare = f"regexp_replace({sql_clean(url)}, '#.*', '')"
    path = f"regexp_extract({bare}, '^[A-Za-z]+://[^/?]*([^?]*)', 1)"
    encoded = (
        f"array_to_string(list_transform(string_split({path}, ''), lambda c: CASE WHEN regexp_matches(c, '[!$-;=@-_a-z|~]') THEN c ELSE url_encode(c) END), '')"
    )
    pairs = (
        f"list_transform(list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda p: p <> ''), lambda p, i: "
        f"{{'n': {_sql_decode('split_part(p, chr(61), 1)')}, 'i': i, 'v': {_sql_decode('''regexp_extract(p, '^[^=]*=(.*)$', 1)''')}}})"
    )
    kept = (
        f"list_sort(list_filter({pairs}, lambda p: NOT (starts_with(lower(p.n), 'utm_') OR lower(p.n) IN "
        "('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source'))))"
    )
    query = f"array_to_string(list_transform({kept}, lambda p: {_sql_form('p.n')} || '=' || {_sql_form('p.v')}), '&')"
    host = f"regexp_extract({bare}, '^([A-Za-z]+://[^/?]*)', 1)"
    return (
        f"(lower(CASE WHEN starts_with(lower({bare}), 'https') THEN regexp_replace({host}, ':443$', '') ELSE regexp_replace({host}, ':80$', '') END) || "
        f"(CASE WHEN rtrim({encoded}, '/') = '' THEN '/' ELSE rtrim({encoded}, '/') END) || (CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END))"
    )


_LINKS = f"""
WITH found AS (
  SELECT page_id, url, a, i - 1 AS pos FROM (
    SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (
      SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"[^"]*"[^>]*>.*?</a>') AS l FROM pages))),
links AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '(?is)href\\s*=\\s*"([^"]*)"', 1) AS href,
    {sql_clean("regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g')")} AS text FROM found)"""
_ODD_LINKS = ", ".join(
    f"({ODD_ID + i}, {pos}, '{href}', '{text}', 'https://odd.example.org{href}')" for i, (_, found) in enumerate(ODD_PAGES) for pos, (href, text) in enumerate(found)
)
_ORIGIN = "regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"
_IDENTITIES = _LINKS + f""",
ids AS (
  SELECT *, 'link|' || (CASE WHEN pos % 6 IN (2, 3, 5) THEN {sql_canonical("'https://links.example.org' || href || '/?utm_source=a'")} ELSE lower(text) END) AS identity_key,
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS host FROM links),
shown AS (
  SELECT identity_key, page_id, pos, href, host, CASE WHEN page_id % 4 <> 0 THEN text || ' on ' || host ELSE '' END AS summary,
    CASE WHEN page_id % 3 = 0 THEN NULL ELSE '' END AS eligibility, CASE WHEN page_id % 2 = 0 THEN text END AS benefit FROM ids)"""


def _sql_longest(name: str) -> str:
    return (
        f"coalesce(arg_min({name}, (-length({name}), page_id, pos)) FILTER (WHERE {name} <> ''), "
        f"arg_max_null({name}, (page_id, pos))) AS {name}"
    )


_LISTED = _LINKS + f""",
worded AS (
  SELECT *, {sql_pick(f'(page_id * 5 + pos) % {len(WORDINGS)}', WORDINGS)} AS wording, {sql_pick(f'(page_id + pos) % {len(MONTHS)}', MONTHS)} AS month_,
    {sql_canonical("'https://agency.example.gov' || href")} AS program_url FROM links),
noted AS (
  SELECT *, {sql_clean("text || month_ || wording")} AS context, 'example_refunds|' || program_url || '|' || text AS identity_ FROM worded WHERE text <> ''),
moded AS (
  SELECT *, CASE WHEN regexp_matches(lower(context), 'no action (?:is )?needed|automatically (?:receive|receiving|sent|distributed)|do not need to (?:apply|file|submit)') THEN 'automatic_distribution'
    WHEN regexp_matches(lower(context), 'only (?:people|consumers|investors) (?:who are )?(?:contacted|invited)|if you (?:receive|received) (?:an? )?(?:notice|invitation|letter)|agency invitation') THEN 'agency_invitation_only'
    ELSE 'unknown' END AS participation_mode, list_distinct_ordered FROM (
      SELECT *, list_transform(regexp_extract_all(context, '\\$\\s*[0-9][0-9,]*(?:\\.\\d{{1,2}})?'), lambda a: replace(a, ' ', '')) AS list_distinct_ordered FROM noted)),
recs AS (
  SELECT page_id, pos, 'gov-ex-' || substr({sql_slug('text')}, 1, 72) || '-' || substr(sha256(identity_), 1, 8) AS record_id, substr(sha256(identity_), 1, 16) AS fingerprint,
    coalesce(nullif({sql_slug("regexp_extract(program_url, '^[a-z]+://[^/]*([^?]*)', 1)")}, ''), substr(sha256(program_url), 1, 16)) AS source_record_id,
    text AS title, program_url, participation_mode,
    CASE WHEN regexp_matches(lower(context), 'no longer accepting (?:claims|forms)|claim (?:window|period) (?:has )?closed') THEN 'closed'
      WHEN regexp_matches(lower(context), 'accepting claims|claim (?:form|window) is open|submit (?:a )?claim by') THEN 'open'
      WHEN participation_mode = 'automatic_distribution' THEN 'not_applicable' ELSE 'unknown' END AS window_status,
    wording AS contact,
    CASE month_ WHEN 'July 2026' THEN '2026-07' WHEN 'june 2025' THEN '2025-06' WHEN 'March  2024' THEN '2024-03' END AS program_date,
    CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS page_modified,
    array_to_string(list_transform(list_filter(list_distinct_ordered, lambda a, i: list_position(list_distinct_ordered, a) = i),
      lambda a: a || '=' || CAST(CAST(replace(replace(a, '$', ''), ',', '') AS DECIMAL(18, 2)) AS VARCHAR)), ';') AS amounts FROM moded
  QUALIFY row_number() OVER (PARTITION BY page_id, record_id ORDER BY pos) = 1)"""

_SEC_SOURCE = "sec_distributions_harmed_investors"
_AGENCY = _LINKS + f""",
placed AS (
  SELECT *, page_id % 3 AS s, {sql_pick(f'(page_id + pos) % {len(MONTHS)}', MONTHS)} AS month_, {sql_pick("page_id % 3", ["ftc_refunds", "cfpb_payments_by_case", _SEC_SOURCE])} AS source_id,
    {sql_pick("page_id % 3", ["FTC", "CFPB", "SEC"])} AS code, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS modified,
    {sql_canonical("CASE page_id % 3 WHEN 0 THEN 'https://www.ftc.gov' || href WHEN 1 THEN 'https://www.consumerfinance.gov' || href ELSE 'https://www.sec.gov" + _SEC_FOLDER + "' || href END")} AS program_url FROM links),
agency_found AS (
  SELECT *, 'gov-' || lower(code) || '-' || substr({sql_slug('text')}, 1, 72) || '-' || substr(sha256(source_id || '|' || program_url || '|' || text), 1, 8) AS record_id,
    CASE month_ WHEN 'July 2026' THEN '2026-07' WHEN 'june 2025' THEN '2025-06' WHEN 'March  2024' THEN '2024-03' END AS program_date
  FROM placed WHERE text <> '' AND NOT (s = 2 AND regexp_matches(lower(text), 'archive|search cases'))
  QUALIFY row_number() OVER (PARTITION BY page_id, record_id ORDER BY pos) = 1)"""

ORACLES = {
    "agency_page_checks": _AGENCY + """,
counted AS (
  SELECT page_id, any_value(source_id) AS source_id, any_value(s) AS s, count(*) AS raw_rows, (SELECT count(*) FROM agency_found f WHERE f.page_id = p.page_id) AS parsed_rows FROM placed p GROUP BY page_id),
judged AS (
  SELECT *, CASE WHEN least(raw_rows, parsed_rows) < (CASE s WHEN 2 THEN 5 ELSE 3 END) THEN 'too few rows' WHEN parsed_rows < 0.8 * raw_rows THEN 'extraction was incomplete' END AS error FROM counted)
SELECT page_id, source_id, raw_rows, parsed_rows, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error FROM judged""",
    "agency_source_records": _AGENCY + f"""
SELECT page_id, source_id, record_id, text AS title, program_url, CASE s WHEN 0 THEN 'active_refund_program' WHEN 1 THEN 'ongoing_payment_case' ELSE 'listed_distribution_matter' END AS program_status,
  concat_ws(';', CASE WHEN s = 0 AND program_date IS NOT NULL THEN 'program_date:' || program_date || ':month:' || {sql_clean('month_')} END,
    CASE WHEN modified IS NOT NULL THEN 'source_page_modified:' || modified || ':day:January' END) AS dates,
  'title,programUrl,' || CASE s WHEN 0 THEN 'activeProgramListMembership' || CASE WHEN month_ <> '' THEN ',programDate' ELSE '' END || ',contact'
    WHEN 1 THEN 'ongoingCaseListMembership,compensationType' || CASE WHEN modified IS NOT NULL THEN ',sourcePageModifiedDate' ELSE '' END
    ELSE 'distributionListMembership' || CASE WHEN modified IS NOT NULL THEN ',sourcePageModifiedDate' ELSE '' END END AS confidence_scope,
  'agency_source_only' AS state, 'View ' || code || ' program' AS label, 'agency_program_page' AS url_role, program_url AS record_url, '{CHECKED_AT}' AS observed_at FROM agency_found""",
    "url_canonical": f"""
SELECT page_id, raw_url, {sql_canonical('raw_url')} AS canonical_url FROM (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '&utm_medium=x&b'
    WHEN 2 THEN regexp_replace(url, '[?#].*', '') || '?b=2&a=1&B=%20x&a=%C3%A9#f'
    WHEN 3 THEN '  ' || regexp_replace(url, '[?#].*', '') || '//?gclid=1&q=a+b&q=A%zz&Source=1'
    ELSE regexp_replace(url, '^(https?)://([^/]*)', '\\1://\\2:443') END AS raw_url FROM pages)""",
    "page_links": _LINKS + f"""
SELECT page_id, pos, href, text, {sql_canonical(f"{_ORIGIN} || href")} AS link_url FROM links
UNION ALL SELECT * FROM (VALUES {_ODD_LINKS})""",
    "page_dedupe": _IDENTITIES + f"""
SELECT identity_key, arg_min(page_id, (page_id, pos)) AS page_id, arg_min(pos, (page_id, pos)) AS pos, arg_min(href, (page_id, pos)) AS href,
  {_sql_longest('summary')}, {_sql_longest('eligibility')}, {_sql_longest('benefit')}, count(*) AS merged_count FROM shown GROUP BY identity_key""",
    "page_dedupe_members": _IDENTITIES + """
SELECT DISTINCT identity_key, 'source_id' AS member, host AS value FROM shown
UNION ALL SELECT DISTINCT identity_key, 'source_record_id', CAST(page_id AS VARCHAR) FROM shown
UNION ALL SELECT DISTINCT identity_key, 'provenance', host || '|' || href FROM shown""",
    "agency_records": _LISTED + "\nSELECT * EXCLUDE (pos) FROM recs",
    "listing_checks": _LISTED + """
SELECT 'example_refunds' AS source_id, (SELECT count(*) FROM links) AS raw_rows, (SELECT count(*) FROM recs) AS parsed_rows,
  CASE WHEN (SELECT count(*) FROM recs) < 0.8 * (SELECT count(*) FROM links) THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN (SELECT count(*) FROM recs) < 0.8 * (SELECT count(*) FROM links) THEN 'extraction was incomplete' END AS error
UNION ALL SELECT 'sec_distributions_harmed_investors', 0, 0, 'failed', 'too few rows'""",
    "page_slugs": _LINKS + f"\nSELECT page_id, pos, {sql_slug('text')} AS slug, text FROM links",
}
