"""Encyclopedia pages: what a page is about, its key in the knowledge base, its address, the pages that it links to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Infoboxes of people, occupations, infoboxes of events, parts of titles of events, words of places.
PERSON_BOXES = ("biography", "person", "military person", "philosopher", "scientist", "writer", "politician", "monarch", "officeholder")
OCCUPATIONS = ("politician", "emperor", "king", "queen", "general", "philosopher", "scientist", "writer", "poet", "composer", "president", "pope")
EVENT_BOXES = (
    "military conflict", "battle", "civil conflict", "civilian attack", "terrorist attack", "earthquake", "eruption",
    "volcanic eruption", "tropical cyclone", "hurricane", "typhoon", "storm", "flood", "wildfire", "tornado", "tsunami",
    "avalanche", "landslide", "election", "referendum", "treaty", "legislation", "constitution", "coronation", "coup",
    "protest", "riot", "aircraft accident", "aviation accident", "ship accident", "rail accident", "shipwreck", "disaster",
    "famine", "pandemic", "epidemic", "spaceflight", "space mission", "expedition", "voyage", "discovery", "event",
    "recurring event", "festival", "academic conference", "summit", "convention", "historical event", "ceremony")
EVENT_TITLES = (
    "battle of", "war of", "siege of", "massacre of", "conquest of", "invasion of", "bombing of", "raid on", "attack on",
    "revolution", "rebellion", "uprising", "coup d", "mutiny", "assassination of", "execution of", "coronation of",
    "abdication of", "treaty of", "congress of", "conference of", "convention of", "accord", "armistice", "peace of",
    "pact of", "earthquake", "eruption", "tsunami", "hurricane", "typhoon", "cyclone", "flood", "famine", "plague",
    "pandemic", "disaster", "explosion", "fire of", "collapse of", "sinking of", "expedition", "voyage of",
    "discovery of", "exploration of", "construction of", "founding of", "destruction of", "fall of")
PLACE_WORDS = ("country", "city", "capital", "province", "region", "island")


def _one_of(words: tuple[str, ...]) -> str:
    return "(" + "|".join(words) + ")"


def page_kind(html: Column, title: Column) -> Column:
    """person, event or location, by the first rule that fits, else null. Rules read the first 80,000 characters, those
    on prose 5,000, on coordinates 10,000; these are the operator's own limits."""
    low = F.lower(F.substring(html, 1, 80000))
    start = F.substring(low, 1, 5000)
    both = lambda a, b: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    lifespan = start.rlike(r"\(\d{4}\s*[–-]\s*\d{4}\)") & start.rlike(" was an? ")
    person = both("personal details", ">born<") | low.rlike("infobox " + _one_of(PERSON_BOXES)) | lifespan | start.rlike("was an? " + _one_of(OCCUPATIONS))
    event = low.rlike("infobox " + _one_of(EVENT_BOXES)) | both("belligerents", "casualties") | F.lower(title).rlike(_one_of(EVENT_TITLES))
    degrees = F.substring(low, 1, 10000).rlike(r"\d+°\d+") & start.rlike(_one_of(PLACE_WORDS))
    place = both("coordinates", "population") | degrees | low.rlike("infobox (settlement|country)")
    return F.when(person, "person").when(event, "event").when(place, "location")


def knowledge_key(html: Column) -> Column:
    """The first Wikidata key that a page links to, else null."""
    return F.nullif(F.regexp_extract(html, r"wikidata\.org/wiki/(Q\d+)", 1), F.lit(""))


def canonical_url(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'<link rel="canonical" href="([^"]+)"', 1), F.lit(""))


def article_links(html: Column) -> Column:
    """Distinct titles of the articles that a page links to, sorted. Anchors, other sites and namespaces are left out: the latter hold a colon."""
    found = F.regexp_extract_all(html, F.lit(r'href="(?:/wiki/|\./)([^"#:]+)"'), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: F.replace(a, F.lit("_"), F.lit(" ")))))
