"""Account classifier: scored rules over names, addresses, web texts, conversions and campaigns.

Rules are a small literal table. Each account's texts meet all rules of their kind in one broadcast join (rules times accounts,
with the regular expression as its condition), scores are sums, and the best type and vertical are the largest sums, ties to the
alphabetically first. Separators count as blanks, so word boundaries work in addresses and code-like names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern, business type, vertical, weight of the name rules.
NAME_RULES = [
    (r"\bbinance\b", "app", "fintech_crypto", 1.0), (r"\b(coinbase|kraken|gemini)\b", "app", "fintech_crypto", 1.0), (r"\blockly\b", "ecommerce", "smart_home", 1.0), (r"\bfunko\b", "ecommerce", "collectibles", 1.0),
    (r"\bmackenzie[- ]?childs\b", "ecommerce", "home_goods", 1.0), (r"\bhoney birdette\b", "ecommerce", "apparel", 1.0), (r"\broots\b", "ecommerce", "apparel", 0.8), (r"\b(loungefly|disney|marvel)\b", "ecommerce", "collectibles", 0.8),
    (r"\b(country club|golf club|invited usa|membership club)\b", "lead_gen", "hospitality_country_club", 0.9), (r"\b(tutors?|tutoring|test prep|lsat|mcat|gmat|gre|sat prep|prep for success)\b", "lead_gen", "education_test_prep", 0.9),
    (r"\b(academy|school|college|university|learning center)\b", "lead_gen", "education", 0.7), (r"\b(plastic surgeons?|cosmetic surger(?:y|ies)|surgeons?|dermatology|dermatologist|medspa|aesthetic[s ]+)\b", "local", "medical_cosmetic", 0.9),
    (r"\b(dental|dentists?|orthodontics?|orthodontists?)\b", "local", "dental", 0.9), (r"\b(medical|clinics?|telehealth|virtual healthcare|aba|therapy|physical therapy|chiropracti[cor]+|wellness|hbot|hospice)\b", "local", "healthcare", 0.7),
    (r"\b(pool|spa|spas|hot tub|swim spa|sauna)\b", "lead_gen", "pool_spa", 0.8), (r"\b(law offices?|law firms?|attorneys?|lawyers?|legal|esq)\b", "lead_gen", "legal", 0.85),
    (r"\b(grant|nonprofit|non[- ]?profit|501c3|charity|foundation|temple|museum|cultural center|public broadcasting|google ad grant)\b", "nonprofit", "nonprofit", 0.9),
    (r"\b(roofing|hvac|plumbing|electrician|contractor|movers?|moving|storage|construction|garage)\b", "lead_gen", "home_services", 0.8), (r"\b(real estate|realtor|residences|apartments|housing)\b", "lead_gen", "real_estate", 0.8),
    (r"\b(beauty|skincare|skin care|cosmetic|hair care|salon)\b", "ecommerce", "beauty", 0.7), (r"\b(fashion|apparel|clothing|jeans|outerwear|shoes?|footwear|denim|jewel)\b", "ecommerce", "apparel", 0.7),
    (r"\b(snacks?|coffee|tea|nutrition|supplements?|chicken|candy|bakery|chocolate|cookware)\b", "ecommerce", "food_beverage", 0.6), (r"\b(toys?|figure|collectible|hobby)\b", "ecommerce", "collectibles", 0.7),
    (r"\b(furniture|decor|home decor|home goods|rugs?|lighting|kitchen|wallpaper|wallcoverings?|hygge)\b", "ecommerce", "home_goods", 0.6), (r"\b(tile|plumbing supply|electrical supply|hardware|paint|drywall|flooring)\b", "ecommerce", "home_improvement", 0.7),
    (r"\b(motorcycle|motorcycles?|auto parts?|car parts?|automotive|moped|scooter|seat|seats|mustang)\b", "ecommerce", "automotive", 0.6), (r"\b(baby|babies|infant|toddler|kids?|children|nursery)\b", "ecommerce", "baby_kids", 0.7),
    (r"\b(vici|vavé|vetta|brax|lily|denim)\b", "ecommerce", "apparel", 0.7), (r"\b(earmuff|earplug|hearing protection|fall protection|safety equipment)", "ecommerce", "safety_gear", 0.7),
    (r"\b(air purifier|water filter|appliance|coway|water purifier)\b", "ecommerce", "appliances", 0.7), (r"\b(pet|pets|petcare|pet food|petsmart|veterinary|kennel)\b", "ecommerce", "pets", 0.7),
    (r"\b(insurance|insure|bank|banking|loan|credit|mortgage|investment)\b", "lead_gen", "finance", 0.7), (r"\b(ev[- ]?charging|ev[- ]?bike|solar|battery|sustainability)\b", "lead_gen", "energy", 0.6),
    (r"\b(tax helpers?|tax services?|tax preparation|tax pros?|h&r block)\b", "lead_gen", "tax_services", 0.85), (r"\b(supplements?|nutrition|mercola|vitamin|wellness brand)\b", "ecommerce", "supplements", 0.7),
    (r"\b(toggl|asana|monday\.com|productivity)\b", "saas", "software", 0.8), (r"\b(rugby|hockey|football|baseball|basketball|outdoor gear|camping|fishing)\b", "ecommerce", "sporting_goods", 0.7),
    (r"\b(holster|tactical|firearm|concealed carry|sports)\b", "ecommerce", "sporting_goods", 0.7), (r"\b(gym|fitness|crossfit|pilates|yoga|workout|spartan race)\b", "ecommerce", "fitness", 0.6),
    (r"\b(fragrance|perfume|cologne|parfum|hair color|haircolor)\b", "ecommerce", "beauty", 0.7), (r"\b(knit|knitwear|wool|sweater|activewear|swimwear|swimsuit)\b", "ecommerce", "apparel", 0.7),
    (r"\b(matcha|olive oil|meal kit|meals to go|granola)\b", "ecommerce", "food_beverage", 0.6), (r"\b(cat|cats|dog|dogs|feline|canine)\b", "ecommerce", "pets", 0.6),
    (r"\b(saas|software|platform|analytics|crm|api|ai[- ]?platform|developer tools)\b", "saas", "software", 0.6), (r"\b(b2b|enterprise|commercial services)\b", "b2b", "b2b_other", 0.5),
]
#: Campaign-name rules.
CAMPAIGN_RULES = [
    (r"\b(country club|tee time|membership)\b", "lead_gen", "hospitality_country_club", 0.6), (r"\b(lsat|mcat|gmat|sat prep|tutor)\b", "lead_gen", "education_test_prep", 0.7),
    (r"\b(crypto|btc|bitcoin|trading fee|deposit|first[- ]?deposit)\b", "app", "fintech_crypto", 0.6), (r"\b(smart lock|smart home|wifi lock|iot)\b", "ecommerce", "smart_home", 0.6),
]
#: Parts of run-together addresses and titles.
SUBSTRINGS = [
    ("skincare", "ecommerce", "beauty", 0.6), ("skinc", "ecommerce", "beauty", 0.5), ("beauty", "ecommerce", "beauty", 0.6), ("cosmetic", "ecommerce", "beauty", 0.6), ("dental", "local", "dental", 0.7), ("dentist", "local", "dental", 0.7),
    ("orthod", "local", "dental", 0.7), ("dermat", "local", "medical_cosmetic", 0.7), ("surgeon", "local", "medical_cosmetic", 0.7), ("plasticsurg", "local", "medical_cosmetic", 0.7), ("medspa", "local", "medical_cosmetic", 0.7),
    ("hottub", "lead_gen", "pool_spa", 0.7), ("swimspa", "lead_gen", "pool_spa", 0.7), ("hotspring", "lead_gen", "pool_spa", 0.6), ("apparel", "ecommerce", "apparel", 0.6), ("clothing", "ecommerce", "apparel", 0.6), ("fashion", "ecommerce", "apparel", 0.5),
    ("nutrition", "ecommerce", "supplements", 0.6), ("supplement", "ecommerce", "supplements", 0.6), ("vitamin", "ecommerce", "supplements", 0.6), ("attorney", "lead_gen", "legal", 0.7), ("lawfirm", "lead_gen", "legal", 0.7), ("lawyers", "lead_gen", "legal", 0.7),
    ("realestate", "lead_gen", "real_estate", 0.6), ("realtor", "lead_gen", "real_estate", 0.6), ("roofing", "lead_gen", "home_services", 0.7), ("plumbing", "lead_gen", "home_services", 0.7), ("hvac", "lead_gen", "home_services", 0.7), ("solar", "lead_gen", "energy", 0.6),
    ("insurance", "lead_gen", "finance", 0.6), ("crypto", "app", "fintech_crypto", 0.6), ("trading", "app", "fintech_crypto", 0.4), ("software", "saas", "software", 0.5), ("furniture", "ecommerce", "furniture", 0.6), ("homedecor", "ecommerce", "home_goods", 0.6),
    ("cookware", "ecommerce", "home_goods", 0.5), ("propertyman", "lead_gen", "real_estate", 0.6), ("apartment", "lead_gen", "real_estate", 0.6), ("therapy", "local", "healthcare", 0.5), ("clinic", "local", "healthcare", 0.5), ("wellness", "local", "healthcare", 0.4),
    ("museum", "nonprofit", "nonprofit", 0.7), ("foundation", "nonprofit", "nonprofit", 0.5), ("tutor", "lead_gen", "education_test_prep", 0.7), ("academy", "lead_gen", "education", 0.5), ("learning", "lead_gen", "education", 0.4), ("recovery", "local", "healthcare", 0.6),
    ("rehab", "local", "healthcare", 0.7), ("golf", "ecommerce", "sporting_goods", 0.6), ("holster", "ecommerce", "sporting_goods", 0.6), ("fragrance", "ecommerce", "beauty", 0.6), ("fragflex", "ecommerce", "beauty", 0.6), ("haircolor", "ecommerce", "beauty", 0.6),
    ("matcha", "ecommerce", "food_beverage", 0.6), ("gymtonic", "ecommerce", "fitness", 0.6), ("meltmethod", "ecommerce", "fitness", 0.6), ("petpad", "ecommerce", "pets", 0.6), ("kneadcat", "ecommerce", "pets", 0.6), ("wool", "ecommerce", "apparel", 0.5), ("knit", "ecommerce", "apparel", 0.5),
]
#: Conversion categories, the business type they speak for, and their weight.
CATEGORIES = {
    "PURCHASE": ("ecommerce", 0.6), "STORE_SALE": ("local", 0.7), "SUBMIT_LEAD_FORM": ("lead_gen", 0.7), "BOOK_APPOINTMENT": ("lead_gen", 0.7), "PHONE_CALL_LEAD": ("lead_gen", 0.6), "IMPORTED_LEAD": ("lead_gen", 0.6),
    "REQUEST_QUOTE": ("lead_gen", 0.6), "GET_DIRECTIONS": ("local", 0.7), "CONTACT": ("lead_gen", 0.4), "DOWNLOAD": ("app", 0.7), "STORE_VISIT": ("local", 0.7), "SUBSCRIBE_PAID": ("saas", 0.5), "SIGNUP": ("saas", 0.5),
    "BEGIN_CHECKOUT": ("ecommerce", 0.3), "ADD_TO_CART": ("ecommerce", 0.3),
}
#: Address endings.
ENDINGS = [(".org", "nonprofit", "nonprofit", 0.7, r"\.org($|/|,)"), (".edu", "nonprofit", "education", 0.7, r"\.edu($|/)"), (".gov", "nonprofit", "government", 0.9, r"\.gov($|/)")]


def rules(spark: SparkSession) -> DataFrame:
    """text (what it is matched against), rule, pattern, business_type, vertical, weight. At most a few hundred rows."""
    rows = []
    for source, factor in (("name", 2.0), ("url", 1.5), ("web", 1.5)):
        rows += [(source, f"{source.upper()}[{p}]", "(?U)" + p, b, v, w * factor) for p, b, v, w in NAME_RULES]
    for source, factor in (("url_raw", 1.0), ("web", 0.8)):
        rows += [(source, f"{source.upper()}_SUB[{p}]", p, b, v, w * factor) for p, b, v, w in SUBSTRINGS]
    rows += [("url_raw", f"URL_TLD[{n}]", p, b, v, w) for n, b, v, w, p in ENDINGS]
    rows += [("campaigns", f"CAMP[{p}]", "(?U)" + p, b, v, w) for p, b, v, w in CAMPAIGN_RULES]
    return spark.createDataFrame(rows, "source string, rule string, pattern string, business_type string, vertical string, weight double")


def _norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[._,\-]+", " ")


def inputs(accounts: DataFrame, daily: DataFrame, conversions: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """One row per account with all that the rules read."""
    names = daily.filter("status = 'ENABLED'").groupBy("account_id").agg(F.array_join(F.array_sort(F.collect_set("campaign_name")), " ").alias("campaigns"), F.max((F.col("campaign_type") == "SHOPPING").cast("int")).alias("shopping"), F.max((F.col("campaign_type") == "APP").cast("int")).alias("app"))
    kinds = conversions.filter("status = 'ENABLED' AND category <> ''").groupBy("account_id", F.upper("category").alias("category")).agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("categories"))
    out = accounts.select("account_id", "account_name", "website_url").join(names, "account_id", "left").join(kinds, "account_id", "left")
    if web is None:
        return out.withColumns({"title": F.lit(""), "description": F.lit("")})
    return out.join(web.select("account_id", "title", "description"), "account_id", "left")


def hits(rows: DataFrame) -> DataFrame:
    """account_id, rule, business_type, vertical, weight of every rule that speaks."""
    spark = rows.sparkSession
    web = _norm(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    texts = F.array(*[F.struct(F.lit(s).alias("source"), t.alias("text")) for s, t in (("name", _norm(F.col("account_name"))), ("url", _norm(F.col("website_url"))), ("url_raw", F.lower(F.coalesce("website_url", F.lit("")))), ("web", web), ("campaigns", _norm(F.col("campaigns"))))])
    long = rows.select("account_id", F.explode(texts).alias("t")).select("account_id", "t.*").filter("trim(text) <> ''")
    own = long.join(F.broadcast(rules(spark)), "source").filter(F.expr("text rlike pattern")).select("account_id", "rule", "business_type", "vertical", "weight")
    table = spark.createDataFrame([(c, b, w) for c, (b, w) in CATEGORIES.items()], "category string, business_type string, weight double")
    shares = rows.filter("categories IS NOT NULL").select("account_id", F.explode("categories").alias("category", "n"), F.aggregate(F.map_values("categories"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    conv = shares.join(F.broadcast(table), "category").select("account_id", F.concat(F.lit("CONV["), "category", F.lit("]")).alias("rule"), "business_type", F.lit("").alias("vertical"), (F.col("weight") * F.col("n") / F.col("total")).alias("weight"))
    kind = lambda c, b: rows.filter(F.col(c) == 1).select("account_id", F.lit(f"CAMP_TYPE[{c}]").alias("rule"), F.lit(b).alias("business_type"), F.lit("").alias("vertical"), F.lit(0.5).alias("weight"))
    return own.unionByName(conv).unionByName(kind("shopping", "ecommerce")).unionByName(kind("app", "app"))


def classify(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """account_id, business_type, vertical, confidence, rule_trace. ``overrides`` (account_id, business_type, vertical) win."""
    spoken = hits(rows)
    types = spoken.groupBy("account_id", "business_type").agg(F.sum("weight").alias("w"))
    best = types.groupBy("account_id").agg(F.min_by("business_type", F.struct((-F.round("w", 9)).alias("w"), "business_type")).alias("business_type"), F.max("w").alias("top"), F.sum("w").alias("total"))
    verts = spoken.filter("vertical <> ''").groupBy("account_id", "vertical").agg(F.sum("weight").alias("w")).groupBy("account_id").agg(F.min_by("vertical", F.struct((-F.round("w", 9)).alias("w"), "vertical")).alias("vertical"))
    trace = spoken.groupBy("account_id").agg(F.array_sort(F.collect_list("rule")).alias("rule_trace"))  # bounded by the rules
    out = rows.select("account_id").join(best, "account_id", "left").join(verts, "account_id", "left").join(trace, "account_id", "left")
    out = out.select("account_id", F.coalesce("business_type", F.lit("unknown")).alias("business_type"), F.coalesce("vertical", F.lit("")).alias("vertical"), F.coalesce(F.round(F.col("top") / F.col("total"), 3), F.lit(0.0)).alias("confidence"), "rule_trace")
    if overrides is None:
        return out
    manual = overrides.select("account_id", F.col("business_type").alias("_b"), F.col("vertical").alias("_v"))
    rows = out.join(manual, "account_id", "left")
    fixed = F.col("_b").isNotNull()
    return rows.select("account_id", F.coalesce("_b", "business_type").alias("business_type"), F.when(fixed, F.coalesce("_v", F.lit(""))).otherwise(F.col("vertical")).alias("vertical"), F.when(fixed, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(fixed, F.array(F.lit("OVERRIDE"))).otherwise(F.col("rule_trace")).alias("rule_trace"))
