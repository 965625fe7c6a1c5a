"""Text functions (T)."""

from pyspark.sql import functions as F

from cairn.functions import names as N
from cairn.operators import columns as C
from cairn.plans.registry import query

NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
SLUG = "regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
PRODUCER = "trim(regexp_replace(regexp_replace({n}, '^(?:" + "|".join(N.PREFIXES) + ") ', ''), ' (?:" + "|".join(N.SUFFIXES) + ")$', ''))"
TRIGRAMS = "list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substr('  ' || {c} || ' ', i, 3)))"
#: The same of each word by itself, in lower case.
WORD_TRIGRAMS = r"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


def replaced(sql, table):
    """SQL with each key replaced by its value, in order."""
    for k, v in table.items():
        sql = f"replace({sql}, '{k}', '{v}')"
    return sql


def norm(c):
    return NORM.format(c=c)


@query("t01_normalise", f"SELECT doc_id, sha256({norm('text')}) AS normal FROM documents")
def t01(t):
    return t.documents.select("doc_id", F.sha2(N.normalise("text"), 256).alias("normal"))


@query("t02_slug", f"SELECT page_id, {SLUG.format(c='url')} AS slug FROM pages")
def t02(t):
    return t.pages.select("page_id", N.slug("url").alias("slug"))


@query("t03_geo_slug", "SELECT doc_id, sha256(" + SLUG.format(c="regexp_replace(text, '[''’]', '', 'g')") + ") AS slug FROM documents")
def t03(t):
    return t.documents.select("doc_id", F.sha2(N.slug("text", drop_apostrophes=True), 256).alias("slug"))


FRONTS = ["Château ", "Domaine de la ", "", "Viña ", "The ", "Quinta do ", "Clos "]
BACKS = [" Vineyards", "", " et Fils", " Brothers", " & Sons"]
NAMED = "(SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in FRONTS) + "][p_size % 7 + 1] || p_name || [" + ", ".join(f"'{x}'" for x in BACKS) + "][p_size % 5 + 1] AS name FROM part)"


def named(t):
    """Parts under made-up producer names."""
    word = lambda words: F.get(F.array(*map(F.lit, words)), F.col("p_size") % len(words))
    return t.part.select("p_partkey", F.concat(word(FRONTS), "p_name", word(BACKS)).alias("name"))


@query("t04_producer_name", f"SELECT p_partkey, {PRODUCER.format(n=norm('name'))} AS producer FROM {NAMED}")
def t04(t):
    return named(t).select("p_partkey", N.producer("name").alias("producer"))


SIZED = "(SELECT p_partkey, p_name || ' ' || (1990 + p_size) || CASE WHEN p_size % 2 = 0 THEN ' 750ml' WHEN p_size % 3 = 0 THEN ' Double Magnum Gift Box' ELSE ' Reserve 3 L' END AS title FROM part)"


def sized(t):
    """Parts under titles with a year and a bottle size."""
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" "), (1990 + F.col("p_size")).cast("string"), F.when(F.col("p_size") % 2 == 0, " 750ml").when(F.col("p_size") % 3 == 0, " Double Magnum Gift Box").otherwise(" Reserve 3 L")).alias("title"))


def without(sql, patterns):
    for pattern in patterns:
        sql = f"regexp_replace({sql}, '{pattern}', '', 'g')"
    return sql


@query("t05_product_name", f"SELECT p_partkey, trim(regexp_replace({replaced(without(norm('title'), N.PRODUCT_PATTERNS), dict.fromkeys(N.NOISE, ''))}, ' +', ' ', 'g')) AS product FROM {SIZED}")
def t05(t):
    return sized(t).select("p_partkey", N.product("title").alias("product"))


@query("t06_year", r"SELECT p_partkey, CAST(nullif(regexp_extract(title, '\b((?:19|20)[0-9]{2})\b', 1), '') AS INT) AS vintage FROM " + SIZED)
def t06(t):
    return sized(t).select("p_partkey", N.year("title").alias("vintage"))


@query("t07_retail_name", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\b(?:19[0-9]{2}|20[12][0-9])\b', ' ', 'g'), ' +', ' ', 'g')) AS retail FROM " + SIZED)
def t07(t):
    return sized(t).select("p_partkey", N.retail("title").alias("retail"))


@query("t08_trigrams", f"SELECT p_partkey, array_to_string(list_sort({TRIGRAMS.format(c='p_name')}), '|') AS grams FROM part")
def t08(t):
    return t.part.select("p_partkey", F.array_join(F.array_sort(N.trigrams("p_name")), "|").alias("grams"))


@query("t09_levenshtein", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM part")
def t09(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("t10_drop_words", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\b(?:the|of|and)\b', ' ', 'g'), ' +', ' ', 'g'))) AS rest FROM documents")
def t10(t):
    return t.documents.select("doc_id", F.sha2(N.drop_words("text", ["the", "of", "and"]), 256).alias("rest"))


FORMS = [", Inc.", " GmbH", " S.A.S.", " Pty", " ltda. ", ",SA", " & Co."]


@query("t11_legal_form", "SELECT s_suppkey, trim(regexp_replace(s_name || [" + ", ".join(f"'{x}'" for x in FORMS) + f"][s_nationkey % 7 + 1], '{N.LEGAL_FORM}', '')) AS name FROM supplier")
def t11(t):
    return t.supplier.select("s_suppkey", N.drop_legal_form(F.concat("s_name", F.get(F.array(*map(F.lit, FORMS)), F.col("s_nationkey") % 7))).alias("name"))


@query("t12_base_name", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(.+)UM') THEN regexp_extract(p_type, '^(.+)UM', 1) ELSE regexp_replace(p_type, '(?:LARGE|PROMO|SMALL)$', '') END AS base FROM part")
def t12(t):
    k = F.col("p_type")
    base = F.when(k.rlike("^(.+)UM"), F.regexp_extract(k, "^(.+)UM", 1)).otherwise(F.regexp_replace(k, "(?:LARGE|PROMO|SMALL)$", ""))
    return t.part.select("p_partkey", base.alias("base"))


@query("t13_country_alias", "SELECT n_nationkey, CASE lower(n_name) WHEN 'nation_3' THEN 'usa' WHEN 'nation_7' THEN 'uk' ELSE lower(n_name) END AS country FROM nation")
def t13(t):
    low = F.lower("n_name")
    return t.nation.select("n_nationkey", F.coalesce(C.mapped(low, {"nation_3": "usa", "nation_7": "uk"}), low).alias("country"))


@query("t14_light_normalise", "SELECT page_id, sha256(trim(lower(nfc_normalize(replace(html, '&amp;', '&'))))) AS light FROM pages")
def t14(t):
    return t.pages.select("page_id", F.sha2(F.trim(F.lower(N.compose(F.replace("html", F.lit("&amp;"), F.lit("&"))))), 256).alias("light"))


@query("t15_transliterate", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Thessaloniki ' WHEN 1 THEN 'Khisarya Kharmanli Topoli ' ELSE 'Shtip aglen Yambol ' END || n_name AS latin FROM nation")
def t15(t):
    k = F.col("n_nationkey") % 3
    place = F.when(k == 0, "Θεσσαλονικι ").when(k == 1, "Хисаря Харманли Тополи ").otherwise("Щип Ъглен Ямбол ")
    return t.nation.select("n_nationkey", N.transliterate(F.concat(place, "n_name")).alias("latin"))


@query("t16_strip_html", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6])[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&eacute;', 'é'), '&egrave;', 'è'), '&rsquo;', '’'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n[ \n]*', chr(10), 'g'), ' ')) AS text FROM pages""")
def t16(t):
    return t.pages.select("page_id", F.sha2(N.strip_html("html"), 256).alias("text"))


ENTITY_TEXT = "html || ' &#8217;' || page_id || '&#' || (page_id % 5000 + 200) || '; &ldquo;x&rdquo; &#12;&#x41; &hellip;<br />  y &amp;#65;'"
NUMERIC = "list_transform(string_split({c}, '&#')[2:], lambda x: CASE WHEN regexp_matches(x, '^0*[0-9]{{1,7}};') AND CAST(regexp_extract(x, '^0*([0-9]{{1,7}});', 1) AS BIGINT) <= 1114111 AND NOT CAST(regexp_extract(x, '^0*([0-9]{{1,7}});', 1) AS BIGINT) BETWEEN 55296 AND 57343 THEN chr(CAST(regexp_extract(x, '^0*([0-9]{{1,7}});', 1) AS INT)) || regexp_replace(x, '^[0-9]+;', '') ELSE '&#' || x END)"
DECODED = "regexp_replace(regexp_replace(string_split({c}, '&#')[1] || coalesce(array_to_string(" + NUMERIC + ", ''), ''), '" + N.SPACE.replace("{", "{{").replace("}", "}}") + "{{2,}}', ' ', 'g'), '^" + N.SPACE.replace("{", "{{").replace("}", "}}") + "+|" + N.SPACE.replace("{", "{{").replace("}", "}}") + "+$', '', 'g')"


@query("t17_decode_entities", f"SELECT page_id, sha256({DECODED.format(c='h')}) AS decoded FROM (SELECT page_id, {replaced(ENTITY_TEXT, N.ENTITIES)} AS h FROM pages)")
def t17(t):
    number = F.concat(F.lit("&#"), (F.col("page_id") % 5000 + 200).cast("string"), F.lit("; &ldquo;x&rdquo; &#12;&#x41; &hellip;<br />  y &amp;#65;"))
    return t.pages.select("page_id", F.sha2(N.decode_entities(F.concat("html", F.lit(" &#8217;"), F.col("page_id").cast("string"), number)), 256).alias("decoded"))


@query("t18_clean_text", "SELECT o_orderkey, nullif(trim(CASE WHEN o_orderstatus = 'O' THEN '  ' ELSE ' ' || o_orderpriority || ' & © é ’ A<' END), '') AS cleaned FROM orders")
def t18(t):
    raw = F.concat(F.lit("\0 "), "o_orderpriority", F.lit("\0 &amp; &copy; &eacute; &#8217; &#x41;&lt; "))
    return t.orders.select("o_orderkey", N.clean(F.when(F.col("o_orderstatus") == "O", "  ").otherwise(raw)).alias("cleaned"))


@query("t19_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split('house of ' || p_name, ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('of', 'the', 'and') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS title FROM part")
def t19(t):
    return t.part.select("p_partkey", N.title_case(F.concat(F.lit("HOUSE OF "), F.upper("p_name"))).alias("title"))


@query("t20_display_name", "WITH b AS (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS kind, regexp_replace(p_name || ' ' || p_brand || ' ' || p_type, ' [A-Z]+$', '') AS base FROM part) SELECT kind, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE kind END AS display FROM b")
def t20(t):
    kinds = t.part.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("kind")).distinct().withColumn("base", F.regexp_replace("kind", " [A-Z]+$", ""))
    siblings = kinds.groupBy("base").agg(F.count("*").alias("n"))
    return kinds.join(siblings, "base").select("kind", F.when(F.col("n") == 1, F.col("base")).otherwise(F.col("kind")).alias("display"))


@query("t21_url_parts", "SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda p: p <> ''), '>') AS parts FROM pages")
def t21(t):
    parts = F.filter(F.split(F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1), "/"), lambda p: p != "")
    return t.pages.select("page_id", F.array_join(parts, ">").alias("parts"))


@query("t22_label_fields", "SELECT page_id, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def t22(t):
    field = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.pages.select("page_id", field('lang="([a-z]+)"').alias("lang"), field("<title>([^<]*)</title>").alias("title"))


@query("t23_price", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.25 END AS price FROM part")
def t23(t):
    """Pages with a price in one of three places, or in none of them; each of them names a shipping fee too."""
    from cairn.functions import parse as X

    size = F.col("p_size")
    places = [F.format_string("$7 fee <td>Item Price $%d.5</td> $1 / 750ml", size), F.format_string("$7 fee, $%d / 750 mL", size), F.format_string('$7 fee <span class="sale price now"> $%d.25</span>', size), F.format_string("$7 fee, $%d", size)]
    return t.part.select("p_partkey", X.page_price(F.get(F.array(*places), size % 4)).alias("price"))


@query("t24_snippet", "SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN greatest(p - 40, 1) > 1 THEN '...' ELSE '' END || substr(text, greatest(p - 40, 1), p + 4 + 80 - greatest(p - 40, 1)) || CASE WHEN p + 4 + 80 - 1 < length(text) THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, instr(lower(text), 'tion') AS p FROM documents)")
def t24(t):
    return t.documents.select("doc_id", N.snippet("text", "tion").alias("snippet"))


BOTTLES = [" (6 Liter)", " (3 liter)", " (Magnum 1.5L)", " magnum 1.5L", " (Half Bottle 375 ml)", " 375mL", " 500 ml", " 750ml"]
BOTTLED = "(SELECT p_partkey, p_name || [" + ", ".join(f"'{x}'" for x in BOTTLES) + "][p_size % 8 + 1] || ' ' || (1990 + p_size) AS title FROM part)"


@query("t25_bottle_format", "SELECT p_partkey, f.format AS format, f.ml AS ml, f.rest AS rest FROM (SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN {{'format': '{n}', 'ml': {ml}, 'rest': trim(regexp_replace(title, '{p}', '', 'g'))}}" for p, n, ml in N.FORMATS) + " ELSE {'format': 'Standard', 'ml': 750, 'rest': title} END AS f FROM " + BOTTLED + ")")
def t25(t):
    title = F.concat("p_name", F.get(F.array(*map(F.lit, BOTTLES)), F.col("p_size") % 8), F.lit(" "), (1990 + F.col("p_size")).cast("string"))
    return t.part.select("p_partkey", N.bottle_format(title).alias("f")).select("p_partkey", F.col("f.name").alias("format"), "f.ml", "f.rest")


KINDS = ["steel", "red", "green", "blue", "copper"]
TITLED = "(SELECT p_partkey, p_name || coalesce(' ' || n_name, '') || CASE p_size % 3 WHEN 0 THEN ' ' || (1990 + p_size) WHEN 1 THEN ' NV' ELSE '' END AS title FROM part LEFT JOIN nation ON p_size % 30 = n_nationkey)"


@query("t26_title_parse", rf"""
WITH v AS (SELECT p_partkey, CAST(nullif(regexp_extract(title, '\b((?:19|20)[0-9]{{2}})\s*$', 1), '') AS INT) AS vintage,
 trim(CASE WHEN regexp_matches(title, '\b(?:19|20)[0-9]{{2}}\s*$') THEN regexp_replace(title, '\b((?:19|20)[0-9]{{2}})\s*$', '') ELSE regexp_replace(title, '(?i)\bNV\s*$', '') END) AS rest FROM {TITLED}),
g AS (SELECT *, list_filter([{', '.join(f"'{k}'" for k in KINDS)}], lambda k: regexp_matches(rest, '(?i)\b' || k || '\b'))[1] AS variety FROM v),
s AS (SELECT *, CASE WHEN variety IS NULL THEN rest ELSE trim(regexp_extract(rest, '(?i)^.*?\b' || variety || '\b(.*)$', 1)) END AS geo,
 CASE WHEN variety IS NOT NULL THEN nullif(trim(regexp_extract(rest, '(?i)^(.*?)\b' || variety || '\b', 1)), '') END AS maker FROM g),
w AS (SELECT p_partkey, string_split(geo, ' ') AS w FROM s), c AS (SELECT p_partkey, i, array_to_string(w[i:], ' ') AS suffix FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
h AS (SELECT p_partkey, arg_min(n_name, i) AS place FROM c JOIN nation ON {norm('n_name')} = {norm('suffix')} GROUP BY p_partkey)
SELECT p_partkey, vintage, variety, maker, place FROM s LEFT JOIN h USING (p_partkey)""")
def t26(t):
    places = t.nation.select(N.normalise("n_name").alias("key"), F.col("n_name").alias("place"))
    end = C.first_match([(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), (1990 + F.col("p_size")).cast("string"))), (F.col("p_size") % 3 == 1, F.lit(" NV"))], F.lit(""))
    rows = t.part.join(t.nation, F.col("p_size") % 30 == F.col("n_nationkey"), "left")
    rows = rows.select("p_partkey", N.trailing_vintage(F.concat("p_name", F.coalesce(F.concat(F.lit(" "), "n_name"), F.lit("")), end)).alias("v")).select("p_partkey", "v.*")
    rows = rows.withColumn("variety", C.first_match([(F.col("rest").rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in KINDS], F.lit(None).cast("string")))
    cut = lambda group: F.coalesce(*[F.when(F.col("variety") == k, F.trim(F.regexp_extract("rest", rf"(?i)^(.*?)\b{k}\b(.*)$", group))) for k in KINDS])
    rows = rows.withColumn("maker", F.nullif(cut(1), F.lit(""))).withColumn("w", F.split(F.coalesce(cut(2), F.col("rest")), " "))
    # The longest ending that is a place: candidates lose their first word one after the other.
    found = rows.select("p_partkey", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))).alias("i", "suffix"))
    found = found.withColumn("key", N.normalise("suffix")).join(places, "key").groupBy("p_partkey").agg(F.min_by("place", "i").alias("place"))
    return rows.join(found, "p_partkey", "left").select("p_partkey", "vintage", "variety", "maker", "place")


@query("t27_query_variants", "SELECT n_nationkey, array_to_string(list_transform(range(1, len(v) + 1), lambda i: v[i]), '|') AS variants FROM (SELECT n_nationkey, CASE WHEN n_name = r_name THEN [n_name] ELSE [n_name || ', ' || r_name, n_name, n_name || ' (' || r_name || ')'] END AS v FROM nation JOIN region ON n_regionkey = r_regionkey)")
def t27(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    other = F.col("n_name") != F.col("r_name")
    variants = F.array(F.when(other, F.concat_ws(", ", "n_name", "r_name")), F.col("n_name"), F.when(other, F.format_string("%s (%s)", "n_name", "r_name")))
    return rows.select("n_nationkey", F.array_join(F.array_distinct(F.filter(variants, lambda v: v.isNotNull())), "|").alias("variants"))


#: Endings of each country's aliases (here by region), and names in another language.
COLOURS = {"EUROPE": [" rouge", " blanc"], "AMERICA": [" red", " white"], "ASIA": [" RED"]}
TRANSLATIONS = {"NATION_1": "Deutschland", "NATION_4": "Zhōngguó", "NATION_6": "nation 6", "NATION_9": "România"}


@query("t28_alias_generation", f"""
WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT n_nationkey, n_name, n_name || s AS alias, 'with_color' AS kind, pr FROM n JOIN (VALUES {', '.join(f"('{r}', '{x}', {i})" for r, xs in COLOURS.items() for i, x in enumerate(xs))}) AS v(r, s, pr) ON r_name = r
 UNION ALL SELECT n_nationkey, n_name, strip_accents('É' || n_name), 'synonym', 10 FROM n UNION ALL SELECT n_nationkey, n_name, n_name || ' AOC', 'with_designation', 20 FROM n WHERE NOT contains(lower(n_name), 'ia')
 UNION ALL SELECT n_nationkey, n_name, v, 'local_name', 30 FROM n JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in TRANSLATIONS.items())}) AS t(k, v) ON n_name = k),
b AS (SELECT *, {norm('alias')} AS k FROM a)
SELECT n_nationkey, k AS alias_normalised, alias, kind FROM b WHERE k <> {norm('n_name')} QUALIFY row_number() OVER (PARTITION BY n_nationkey, k ORDER BY pr) = 1""")
def t28(t):
    """Aliases by colour and country, without accents, by designation and by translation; the first of equal ones, none equal to the name."""
    from cairn.operators.dedup import first_by

    made = lambda alias, kind, pr: F.struct(alias.alias("alias"), F.lit(kind).alias("kind"), F.lit(pr).alias("pr"))
    name = F.col("n_name")
    aliases = [F.when(F.col("r_name") == r, made(F.concat(name, F.lit(x)), "with_color", i)) for r, xs in COLOURS.items() for i, x in enumerate(xs)]
    aliases += [made(N.strip_accents(F.concat(F.lit("É"), name)), "synonym", 10), F.when(~F.contains(F.lower(name), F.lit("ia")), made(F.concat(name, F.lit(" AOC")), "with_designation", 20))]
    aliases += [F.when(name == k, made(F.lit(v), "local_name", 30)) for k, v in TRANSLATIONS.items()]
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", N.normalise("n_name").alias("own"), F.explode(F.array(*aliases)).alias("x")).filter("x is not null")
    keyed = rows.select("n_nationkey", "own", "x.*").withColumn("alias_normalised", N.normalise("alias")).filter("alias_normalised <> own")
    return first_by(keyed, ["n_nationkey", "alias_normalised"], [F.asc("pr")]).select("n_nationkey", "alias_normalised", "alias", "kind")


@query("t29_display", "SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) || '...' AS short FROM events")
def t29(t):
    return t.events.select("event_id", F.concat(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), F.lit("...")).alias("short"))


@query("t30_banned_words", "SELECT doc_id, array_to_string(list_filter(['idiot', 'moron', 'trash'], lambda w: contains(lower(text || ' ' || source), w)), ',') AS banned FROM documents")
def t30(t):
    whole = F.lower(F.concat_ws(" ", "text", "source"))
    return t.documents.select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, ["idiot", "moron", "trash"])), lambda w: F.contains(whole, w)), ",").alias("banned"))


@query("t31_primary_code", "SELECT page_id, CASE string_split(codes, '|')[1] WHEN 'com' THEN 'C' WHEN 'org' THEN 'O' ELSE 'X' END AS code FROM (SELECT page_id, regexp_extract(url, '\\.(com|org|net)', 1) || '|zz' AS codes FROM pages)")
def t31(t):
    codes = F.concat(F.regexp_extract("url", r"\.(com|org|net)", 1), F.lit("|zz"))
    return t.pages.select("page_id", C.mapped(F.split(codes, r"\|")[0], {"com": "C", "org": "O"}, "X").alias("code"))
