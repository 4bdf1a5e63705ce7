"""JSON-LD, link relations and names on pages made of parts and suppliers (X2, X3, X3f)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structured as O
from .registry import Tables, query

c = F.col


def json_ld_pages(t: Tables) -> DataFrame:
    """A page for each part: a product with an offer and a maker that is named elsewhere, a question, a broken block, another script."""
    k, none = c("p_partkey"), F.lit(None).cast("string")
    node = lambda **x: F.struct(*(v.alias(n.replace("AT_", "@")) for n, v in x.items()))
    maker = node(AT_id=F.lit("#maker"), AT_type=F.array(F.lit("Thing"), F.lit("Bakery")), name=F.concat(F.lit("Maker  "), (k % 7).cast("string")), url=F.lit("https://maker.example"), telephone=F.when(k % 3 == 0, "n/a").otherwise("+1 555"))
    offer = node(AT_type=F.lit("Offer"), price=(k % 50), priceCurrency=F.lit("EUR"))
    product = node(AT_type=F.lit("Product"), name=c("p_name"), brand=node(AT_id=F.lit("#maker")), category=F.array(c("p_type"), F.lit("x")), offers=F.array(offer, offer), hidden=F.lit(True))
    question = node(AT_type=F.lit("Question"), name=F.lit("Is it  good?"), acceptedAnswer=F.array(node(AT_id=F.lit("#yes"), text=none), node(AT_id=none, text=F.lit("Maybe"))))
    answer = node(AT_id=F.lit("#yes"), AT_type=F.lit("Answer"), text=F.lit("Yes"))
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(
        F.lit("<html><script>var a = 1;</script>"), script(F.to_json(F.struct(F.lit("x").alias("@context"), F.struct(maker.alias("a"), product.alias("b"), answer.alias("c"), question.alias("d")).alias("@graph")))),
        F.when(k % 4 == 0, script(F.lit("{broken"))).otherwise(""), F.when(k % 5 == 0, script(F.to_json(maker))).otherwise(""),
    )
    return t.spread("part").select(k.alias("page_id"), html.alias("html"))


@query("""WITH l AS (SELECT p_partkey AS page_id, unnest(list_filter([
              'Business name: Maker ' || p_partkey % 7, 'URL: https://maker.example/', CASE WHEN p_partkey % 3 <> 0 THEN 'Telephone: +1 555' END, 'Product name: ' || p_name, 'Brand: #maker', 'Category: ' || p_type || ', x',
              'Price: ' || p_partkey % 50, 'Price currency: EUR', 'FAQ answer: Yes', 'Business name: Is it good?', 'FAQ question: Is it good?', 'FAQ answer: Maybe'], lambda x: x IS NOT NULL)) AS line FROM part)
          SELECT page_id, line FROM l UNION ALL SELECT p_partkey, 'Business name: Yes' FROM part WHERE false""")
def x2_json_ld_facts(t: Tables) -> DataFrame:
    return O.json_ld(json_ld_pages(t))[0].select("page_id", "line")


@query("SELECT p_partkey AS page_id, 1 + (p_partkey % 4 = 0)::INT + (p_partkey % 5 = 0)::INT AS blocks, (p_partkey % 4 = 0)::INT AS broken, 6 + (p_partkey % 5 = 0)::INT AS entities FROM part")
def x2_json_ld_counts(t: Tables) -> DataFrame:
    return O.json_ld(json_ld_pages(t))[1].drop("said")


def _link_pages(t: Tables) -> DataFrame:
    k = c("s_suppkey")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    html = F.concat(
        text("<head><link rel='stylesheet' href='/a.css'><LINK REL=\"next canonical\" HREF=\"/p/", k, "?x=1#y\">"), F.when(k % 2 == 0, text('<link href="//www.s', k, '.example/second" rel=canonical rel="canonical">')).otherwise(""),
        text("<link rel='alternate' hreflang='DE' href='de/", k, "'><link rel=\"alternate\" href=\"https://other.example/\"><link rel='alternate' hreflang=fr href='/blog/x'><link rel='alternate' hreflang='es' href='/es?a=1&amp;b=2'></head>"),
    )
    return t.supplier.select(k.alias("page_id"), text("https://s", k, ".example/dir/page").alias("url"), html.alias("html"))


@query("SELECT s_suppkey AS page_id, 'https://s' || s_suppkey || '.example/p/' || s_suppkey AS canonical FROM supplier")
def x3_canonical_urls(t: Tables) -> DataFrame:
    return O.link_relations(_link_pages(t))[0]


@query("""SELECT s_suppkey AS page_id, unnest(['https://s' || s_suppkey || '.example/dir/de/' || s_suppkey, NULL, NULL, 'https://s' || s_suppkey || '.example/es']) AS url, unnest(['de', '', '', 'es']) AS language FROM supplier""")
def x3_alternates(t: Tables) -> DataFrame:
    return O.link_relations(_link_pages(t))[1].drop("place")


TITLES = ["Home", "Acme  Works | Home", "About us", "Pricing - Acme", "Beta::x", "Gamma :: y"]


@query(f"""WITH p AS (SELECT o_custkey AS site, o_orderkey AS place, CASE WHEN o_orderkey % 4 = 0 THEN 'home' ELSE 'page' END AS type, regexp_replace({TITLES!r}[o_orderkey % {len(TITLES)} + 1], ' +', ' ', 'g') AS title FROM orders),
           h AS (SELECT site, arg_min(title, (type <> 'home', place)) AS home FROM p GROUP BY site),
           s AS (SELECT c_custkey AS site, CASE c_custkey % 4 WHEN 0 THEN 'Contact' WHEN 1 THEN 'Real Name' WHEN 2 THEN 'about US' ELSE '' END AS e FROM customer),
           x AS (SELECT s.*, trim(regexp_extract(coalesce(home, ''), '^(.*?)(?: (?:\\||[-–—]|::) |$)', 1)) AS cand, EXISTS (SELECT 1 FROM p WHERE p.site = s.site AND type <> 'home' AND lower(title) = lower(e)) AS is_page FROM s LEFT JOIN h USING (site))
           SELECT site, CASE WHEN e = 'Real Name' AND NOT is_page THEN e WHEN cand NOT IN ('', 'Home') THEN cand ELSE 'The Shop ' || site END AS name FROM x""")
def x3f_business_names(t: Tables) -> DataFrame:
    k = c("c_custkey")
    sites = t.customer.select(k.alias("site"), F.when(k % 4 == 0, "Contact").when(k % 4 == 1, " Real  Name").when(k % 4 == 2, "about US").alias("extracted"), F.concat(F.lit("https://www.the-shop_"), k.cast("string"), F.lit(".example:8080/x")).alias("url"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), (c("o_orderkey") % len(TITLES) + 1).cast("int"))
    pages = t.orders.select(c("o_custkey").alias("site"), c("o_orderkey").alias("place"), F.when(c("o_orderkey") % 4 == 0, "home").otherwise("page").alias("type"), title.alias("title"))
    return O.business_names(sites, pages)
