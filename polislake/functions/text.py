"""Text and scalar functions of the adapters and analyses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles, stop words, topics and keyword lists.
TITLES = ("mr.", "mrs.", "ms.", "dr.", "prof.", "hon.", "sir", "madam")
TOPIC_STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "into", "through", "during", "before", "after", "above", "below",
    "up", "down", "out", "off", "over", "under", "again", "further", "then", "once",
)
KEYWORD_STOP_WORDS = (
    "this", "that", "with", "have", "will", "from", "they", "been", "their", "said", "each", "which", "what", "where", "when", "would", "there", "could", "should",
)
TOPIC_KEYWORDS = {
    "climate": ("climate", "environment", "green", "carbon", "emission", "sustainable"),
    "democracy": ("democracy", "democratic", "participation", "citizen", "voting"),
    "policy": ("policy", "regulation", "law", "legislation", "reform"),
    "economy": ("economy", "economic", "financial", "budget", "tax"),
    "health": ("health", "medical", "healthcare", "pandemic", "safety"),
    "education": ("education", "school", "university", "learning", "student"),
    "technology": ("technology", "digital", "internet", "data", "ai"),
    "immigration": ("immigration", "migration", "refugee", "border"),
    "transport": ("transport", "traffic", "mobility", "public transport"),
    "housing": ("housing", "accommodation", "rental", "property"),
}
ARGUMENT_MARKERS = ("because", "therefore", "since", "thus", "hence")
SPACES = r"(?U)\s+"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_html(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def local_name(iri: Column) -> Column:
    """After the last #, else after the last /."""
    return F.when(F.instr(iri, "#") > 0, F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def str_after(c: Column, mark: str) -> Column:
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise(F.lit(""))


def str_before(c: Column, mark: str) -> Column:
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.lit(""))


def shorten(c: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(tail))).otherwise(c)


def normalize_name(c: Column, compat: bool = False) -> Column:
    """Lower case, no titles, no punctuation, single spaces. Titles are words; compat removes them as substrings anywhere."""
    out = F.lower(c)
    if compat:
        for t in TITLES:
            out = F.replace(out, F.lit(t), F.lit(""))
    else:
        words = "|".join(t.replace(".", r"\.") for t in TITLES)
        out = F.regexp_replace(out, rf"(?U)(?<!\w)(?:{words})(?!\w)", "")
    return collapse(F.regexp_replace(out, r"(?U)[^\w\s]", ""))


def slug(c: Column) -> Column:
    # A class by name: ranges under a negation take Java eight times as long.
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"[^\p{Alnum}\s]", "")), r"\s+", "_"))


def participant_id(name: Column, platform: Column) -> Column:
    return F.concat(F.lit("participant_"), platform, F.lit("_"), slug(name))


def organization_id(name: Column) -> Column:
    return F.concat(F.lit("org_"), F.translate(name, " /", "__"))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def topic_tokens(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), SPACES)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TOPIC_STOP_WORDS)))


def keywords(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z]{4,})\b")), lambda w: ~w.isin(*KEYWORD_STOP_WORDS))


def topic_tags(c: Column, most: int = 3, topics: dict[str, tuple[str, ...]] = TOPIC_KEYWORDS) -> Column:
    """The first `most` topics, in dictionary order, one of whose keywords is a substring of the text."""
    return lowered_tags(F.lower(c), most, topics)


def lowered_tags(low: Column, most: int = 3, topics: dict[str, tuple[str, ...]] = TOPIC_KEYWORDS) -> Column:
    """topic_tags of a text in lower case. No higher-order function: inside one, Spark shares no expression and compiles none."""
    hits = [F.when(F.greatest(*[low.contains(k).cast("int") for k in (*words, words[0])]) == 1, F.lit(name)) for name, words in topics.items()]
    found = F.concat_ws("\u0001", *hits)
    return F.when(found != "", F.slice(F.split(found, "\u0001"), 1, most)).otherwise(F.array().cast("array<string>"))


def title_case(role: Column) -> Column:
    return F.initcap(F.replace(F.substring_index(role, "/", -1), F.lit("_"), F.lit(" ")))


def speaker_parts(c: Column) -> tuple[Column, Column, Column]:
    """Name, role and group of "Name, role (Group)" or "President"."""
    group = F.nullif(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit(""))
    head = F.trim(F.split(c, r"\(").getItem(0))
    name = F.trim(F.split(head, ",").getItem(0))
    role = F.when(c.contains("President"), F.lit("President")).otherwise(F.nullif(F.trim(F.regexp_extract(head, r",(.*)$", 1)), F.lit("")))
    return name, role, group


def title_date(c: Column) -> Column:
    """The date in "... 10 March 2025 ..."."""
    return F.try_to_timestamp(F.regexp_extract(c, r"(\d{1,2} [A-Z][a-z]+ \d{4})", 1), F.lit("d MMMM yyyy")).cast("date")


def video_time(c: Column) -> Column:
    """playerStartTime=YYYYMMDD-HH:MM:SS as an ISO time."""
    p = r"playerStartTime=(\d{4})(\d{2})(\d{2})-(\d{2}:\d{2}:\d{2})"
    g = lambda i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(p), F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), g(4)))


def day_hour(c: Column) -> Column:
    """dd/MM/yyyy HH as an ISO time, null if it is none."""
    return F.date_format(F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH")), "yyyy-MM-dd'T'HH:mm:ss")


def iso_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def without_zone(c: Column) -> Column:
    """A time with Z or an offset as UTC without a zone, as times without one are taken; others as they are."""
    return F.when(c.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), F.coalesce(F.date_format(F.to_utc_timestamp(iso_time(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), c)).otherwise(c)


def sitting_date(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"(\d{4}-\d{2}-\d{2})", 1)


def case_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{2}-\d+)", 1), F.lit(""))


def case_name(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"([A-Z][\w.' ]+ v\. [A-Z][\w.' ]+)", 1)), F.lit(""))


def court_role(speaker: Column) -> Column:
    up = F.upper(speaker)
    return (
        F.when(up.contains("CHIEF JUSTICE"), "Chief Justice").when(up.contains("JUSTICE"), "Justice")
        .when(up.contains("MR."), "Attorney").when(up.contains("MS."), "Attorney").otherwise("Other")
    )


def first_language(*choices: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def url_tail(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "?", 1), "/", -1)


def json_items(c: Column, schema: str) -> Column:
    """A JSON array of structs; an empty array for what is none."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit("[]"), schema))


def model_items(c: Column) -> Column:
    """The fallacies in a language model's answer: the outermost [...], items without a type left out, bad scores as null."""
    inner = F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    raw = json_items(inner, "array<struct<type:string,segment:string,confidence:string>>")
    return F.transform(
        F.filter(raw, lambda x: x["type"].isNotNull()),
        lambda x: F.struct(x["type"].alias("type"), F.coalesce(x["segment"], F.lit("")).alias("segment"), F.coalesce(x["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence")),
    )


def whole_number(c: Column) -> Column:
    return c.cast("string").try_cast("bigint")


def rules(c: Column, cases: tuple[tuple[tuple[str, ...], str], ...], default: str) -> Column:
    """The value of the first case one of whose marks is in the lower-cased text."""
    low, out = F.lower(c), F.lit(default)
    for marks, value in reversed(cases):
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = F.when(hit, value).otherwise(out)
    return out


# Platform names by process name, platform ids by address, labels by id.
PLATFORM_BY_NAME = (
    (("madrid",), "Decide Madrid"),
    (("parliament", "ep_debate"), "European Parliament"),
    (("decidim", "barcelona"), "Decidim Barcelona"),
    (("delidata",), "DeliData"),
    (("habermas",), "Habermas Machine"),
    (("eu_have_your_say", "have your say"), "EU Have Your Say"),
    (("supreme_court", "us_supreme"), "US Supreme Court"),
)
PLATFORM_BY_ADDRESS = (
    (("yourpriorities", "/point-"), "yourpriorities"),
    (("habermas", "hm_"), "habermas"),
    (("decidemadrid", "madrid", "dm_"), "decidemadrid"),
    (("haveyoursay", "eu_hys"), "haveyoursay"),
    (("scotus", "sc_"), "scotus"),
    (("decidim", "db_"), "decidim_barcelona"),
    (("delidata", "dd_"), "delidata"),
)
PLATFORM_LABELS = {
    "habermas": "Habermas Machine",
    "decidemadrid": "Decide Madrid",
    "ep_debate": "European Parliament Debates",
    "haveyoursay": "EU Have Your Say",
    "yourpriorities": "Your Fallacious Priorities",
    "scotus": "US Supreme Court",
    "decidim_barcelona": "Decidim Barcelona",
    "delidata": "DeliData",
}


def platform_by_name(process: Column) -> Column:
    return rules(process, PLATFORM_BY_NAME, "Other Platform")


def platform_by_address(address: Column, compat: bool = False) -> Column:
    """compat keeps the narrower rules, by which euhys_ and us_supreme_ addresses fall to the default."""
    cases = PLATFORM_BY_ADDRESS
    if not compat:
        cases = tuple(((*marks, *{"haveyoursay": ("euhys_",), "scotus": ("us_supreme_",)}.get(v, ())), v) for marks, v in cases)
    return rules(address, cases, "ep_debate")


def platform_id(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("your priorities", "your fallacious priorities"), "yourpriorities").otherwise(F.translate(low, " .", "__"))


def platform_label(pid: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in PLATFORM_LABELS.items() for x in pair])[pid], F.initcap(pid))
