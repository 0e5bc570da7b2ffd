"""Column expressions on text and URLs."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tracking parameters and junk rules of the feed reader.
TRACKING = r"(?i)^(utm_|fbclid$|gclid$|mc_|ref$|ref_src$|cmpid$|ito$|ns_|at_|xtor$|ocid$|taid$|amp$)"
JUNK_TITLE = (r"(?i)\b(horoscope|sponsored|advertorial|partner content|crossword|sudoku|wordle|quiz of the|deal of the day"
              r"|coupon|promo code|best deals?)\b")
JUNK_PATH = r"(?i)/(sponsored|advertorial|partner-content|horoscopes?|puzzles?|crosswords?|deals|coupons?|podcasts?)(/|$)"
# Words left out of title tokens.
STOP_WORDS = ["a", "an", "the", "in", "on", "at", "of", "for", "and", "or", "to", "is", "are", "was"]
# Words that name a hazard in news (wide list), and the shorter list of the strict linker.
DISASTER_KEYWORDS = {
    "earthquake": ["earthquake", "quake", "seismic", "tremor", "aftershock", "tsunami"],
    "wildfire": ["wildfire", "bushfire", "forest fire", "brush fire", "blaze", "smoke"],
    "cyclone": ["cyclone", "typhoon", "hurricane", "tropical storm", "landfall"],
    "flood": ["flood", "flooding", "floods", "inundation", "deluge", "flash flood"],
    "volcano": ["volcano", "volcanic", "eruption", "erupts", "lava", "ash cloud"],
    "drought": ["drought", "water shortage", "famine", "crop failure"],
}
STRICT_DISASTER_KEYWORDS = {
    "earthquake": ["earthquake", "quake", "seismic", "tremor"],
    "wildfire": ["wildfire", "fire", "bushfire", "blaze", "smoke"],
    "cyclone": ["cyclone", "typhoon", "hurricane", "storm", "tropical"],
    "flood": ["flood", "flooding", "inundation", "deluge", "water"],
    "volcano": ["volcano", "volcanic", "eruption", "lava", "ash"],
    "drought": ["drought", "dry", "water shortage", "famine"],
}
# Phrases that make a stated mechanism worthless.
GENERIC_PHRASES = ["same region", "same area", "same country", "same time", "same period", "both occurred", "both happened",
                   "nearby", "close proximity", "geographic proximity", "similar location", "around the same"]
SPECULATIVE_PHRASES = ["could potentially", "might have", "may have", "possibly", "perhaps", "it is possible", "could be related",
                       "may be related", "might be related", "speculative", "unclear whether", "no direct"]
# Relations a link may carry.
ALLOWED_RELATIONS = ["co_occurs", "same_place", "same_topic", "reported_together"]

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _form_encode(text: Column) -> Column:
    raw = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(raw), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no tracking parameters, no fragment; other parameters are kept and re-encoded."""
    url = F.trim(url)
    part = lambda k: F.regexp_extract(url, _URL, k)
    scheme, host, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)

    def pair(item: Column) -> Column:
        key = _form_encode(F.substring_index(item, "=", 1))
        value = F.when(F.contains(item, F.lit("=")), F.regexp_replace(item, "^[^=]*=", "")).otherwise(F.lit(""))
        return F.concat(key, F.lit("="), _form_encode(value))

    kept = F.filter(F.split(query, "&"),
                    lambda item: (item != "") & ~F.rlike(F.coalesce(F.try_url_decode(F.substring_index(item, "=", 1)),
                                                                    F.substring_index(item, "=", 1)), F.lit(TRACKING)))
    clean = F.array_join(F.transform(kept, pair), "&")
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
                    F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")), path,
                    F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(F.lit("")))


def url_host(url: Column) -> Column:
    """Host name without credentials or port, lower case; blank where there is none."""
    netloc = F.regexp_extract(F.trim(url), _URL, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _URL, 3)


def site_domain(url: Column) -> Column:
    """Host without the usual subdomains, each removed once in this order."""
    host = url_host(url)
    for prefix in ("www.", "feeds.", "feed.", "rss.", "m."):
        host = F.regexp_replace(host, "^" + prefix.replace(".", r"\."), "")
    return host


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All named and numeric HTML entities, in Arrow batches (Spark has no built-in for the full table)."""
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")


@F.pandas_udf(T.StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    """As ``unescape``, but only entities that end with their semicolon; what is cut off in the middle stays as it is."""
    known = lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html.entities.html5 else m[0]
    return text.map(lambda t: _CLOSED.sub(known, t), na_action="ignore")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cut_words(text: Column, limit: int) -> Column:
    head = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    return F.when(F.char_length(text) > limit, F.concat(head, F.lit("…"))).otherwise(text)


def clean_text(text: Column, limit: int | None = None, closed: bool = False) -> Column:
    """Plain text of an HTML snippet, optionally cut at a word with an ellipsis. ``closed``: entities count only with their semicolon."""
    plain = squeeze((unescape_closed if closed else unescape)(strip_tags(text)))
    return plain if limit is None else cut_words(plain, limit)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, exclamation or question mark, else the first 120 characters."""
    sentence = F.trim(F.regexp_extract(text, r"^([^.!?]+[.!?])", 1))
    return F.when(sentence != "", sentence).otherwise(F.substring(text, 1, 120))


def crowd_size(tags: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(tags, r"(?i)crowd size\s*=\s*([^;]+)", 1)), F.lit(""))


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words longer than two letters, without stop words."""
    words = F.split(F.lower(squeeze(F.coalesce(title, F.lit("")))), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 where either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """Lower-case ASCII words separated and surrounded by one space."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def word_list(text: Column) -> Column:
    return F.filter(F.split(words(text), " +"), lambda w: w != "")


def has_any_word(haystack: Column, keywords: Column) -> Column:
    """Whether any keyword occurs as whole words in normalised text."""
    return F.exists(keywords, lambda k: F.contains(haystack, F.concat(F.lit(" "), F.trim(words(k)), F.lit(" "))))


def phrase_pattern(phrases: list[str]) -> str:
    quoted = "|".join(p.replace(".", r"\.") for p in phrases)
    return rf"(?U)\b(?:{quoted})\b"


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase occurs as whole words, ignoring case."""
    return F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit(phrase_pattern(phrases)))


def mentioned_hazards(text: Column) -> Column:
    """The hazard kinds whose words occur in the text."""
    named = [F.when(has_phrase(text, phrases), F.lit(kind)) for kind, phrases in DISASTER_KEYWORDS.items()]
    return F.array_compact(F.array(*named))


def search_words(title: Column, terms: Column) -> Column:
    """Distinct lower-case words of the title and terms, sorted."""
    words_of = F.split(F.lower(F.concat_ws(" ", title, F.array_join(terms, " "))), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words_of, lambda t: t != "")))


def keyword_hits(tokens: Column, full: Column, keywords: Column) -> Column:
    """Share of the keywords found in prepared text: phrase 1, any single word 0.5; neutral 0.5 without keywords.

    keywords: array of lower-case struct(phrase, parts); tokens as from ``search_words``, full is their text.
    """
    hit = lambda k: F.when(F.contains(full, k["phrase"]), 1.0).when(F.arrays_overlap(tokens, k["parts"]), 0.5).otherwise(0.0)
    total = F.aggregate(keywords, F.lit(0.0), lambda acc, k: acc + hit(k))
    return F.when(F.size(keywords) > 0, F.least(F.lit(1.0), total / F.size(keywords))).otherwise(F.lit(0.5))


def prepared_keywords(keywords: Column) -> Column:
    return F.transform(keywords, lambda k: F.struct(F.lower(k).alias("phrase"), F.split(F.trim(F.lower(k)), r"\s+").alias("parts")))


def keyword_score(title: Column, terms: Column, keywords: Column) -> Column:
    """Share of the user's keywords found in an event's words."""
    score = lambda tokens: keyword_hits(tokens, F.array_join(tokens, " "), prepared_keywords(keywords))
    return F.get(F.transform(F.array(search_words(title, terms)), score), 0)


def disaster_overlap(terms: Column, category: Column) -> Column:
    """Keywords that contain, or are contained in, a word of the hazard; three matches make 1."""
    def matches(names: list[str]) -> Column:
        hit = lambda t: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(t, n) | F.contains(n, t))
        return F.size(F.filter(F.transform(terms, F.lower), hit))

    count = F.lit(0)
    for kind, names in STRICT_DISASTER_KEYWORDS.items():
        count = F.when(category == kind, matches(names)).otherwise(count)
    return F.when(F.size(terms) > 0, F.least(F.lit(1.0), count / 3.0)).otherwise(F.lit(0.0))


def geocode_query(country: Column, region: Column, city: Column, specificity: Column) -> Column:
    """Place text to look up, as fine as the stated specificity allows; blank if there is none."""
    country, region, city = (F.trim(F.coalesce(c, F.lit(""))) for c in (country, region, city))
    with_country = lambda place: (place != "") & (country != "")
    joined = lambda place: F.concat(place, F.lit(", "), country)
    by_region = F.when(with_country(region), joined(region)).otherwise(country)
    return (F.when(specificity.isin("precise", "city"), F.when(with_country(city), joined(city)).otherwise(by_region))
            .when(specificity == "region", by_region).when(specificity == "country", country).otherwise(F.lit("")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def conflict_title(subtype: Column, event_type: Column, location: Column, country: Column) -> Column:
    """"Kind in location, country", without the parts that are blank."""
    place = F.concat_ws(", ", blank_to_null(location), blank_to_null(country))
    what = F.coalesce(blank_to_null(subtype), event_type)
    return F.when(place != "", F.concat(what, F.lit(" in "), place)).otherwise(what)


def meta_image(page_url: Column, page: Column) -> Column:
    """Image named by the page's og:image or twitter:image tag, made absolute."""
    # The names and patterns of image tags.
    tag = (r"(?i)<meta\b[^>]*?(?:property|name)\s*=\s*[\"'](?:og:image(?::secure_url)?|og:image:url|twitter:image(?::src)?)[\"'][^>]*>")
    contents = F.transform(F.regexp_extract_all(page, F.lit(tag), F.lit(0)),
                           lambda t: F.regexp_extract(t, r"(?i)\bcontent\s*=\s*[\"']([^\"']+)[\"']", 1))
    first = F.try_element_at(F.filter(contents, lambda c: c != ""), F.lit(1))
    return absolute_url(page_url, F.trim(unescape(first)))


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from its page."""
    scheme, host = F.regexp_extract(base, _URL, 1), F.regexp_extract(base, _URL, 2)
    root = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(base, _URL, 3)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(link)))
            # A query keeps the page's path, a fragment its query as well; an empty link is the page itself.
            .when(F.startswith(link, F.lit("?")), F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), link))
            .when((link == "") | F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
            .when(link.isNotNull(), F.concat(root, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link)))))


def _without_dots(path: Column) -> Column:
    """A path without its steps "." and ".."; query and fragment stay as they are."""
    rest = F.regexp_extract(path, r"[?#].*$", 0)
    steps = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    # A trailing dot step leaves a slash.
    ended = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    walked = F.aggregate(F.slice(ended, 2, F.greatest(F.size(ended) - 1, F.lit(0))), F.array().cast("array<string>"), lambda done, step: (
        F.when(step == ".", done).when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(step)))))
    return F.when(F.contains(path, F.lit("./")) | F.rlike(path, F.lit(r"/\.{1,2}([?#]|$)")), F.concat(F.lit("/"), F.array_join(walked, "/"), rest)).otherwise(path)


def entry_image(media: Column, enclosures: Column, summary: Column) -> Column:
    """First image of a feed entry: media item, image enclosure, else an <img> in the summary."""
    from_media = F.try_element_at(F.filter(media, lambda m: (F.coalesce(m["url"], F.lit("")) != "") & (
        m["medium"].isNull() | (m["medium"] == "image") | F.startswith(F.coalesce(m["type"], F.lit("")), F.lit("image")))), F.lit(1))["url"]
    from_link = F.try_element_at(F.filter(enclosures, lambda e: (e["rel"] == "enclosure") & F.startswith(
        F.coalesce(e["type"], F.lit("")), F.lit("image")) & (F.coalesce(e["href"], F.lit("")) != "")), F.lit(1))["href"]
    from_html = unescape(F.nullif(F.regexp_extract(F.coalesce(summary, F.lit("")), '<img[^>]+src="([^"]+)"', 1), F.lit("")))
    return F.coalesce(from_media, from_link, from_html)


def title_case(text: Column) -> Column:
    """Capital after the start, white space, slash or hyphen; the rest lower case."""
    pieces = F.split(F.lower(text), r"(?<=[\s/\-])")
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.char_length(p)))
    return F.array_join(F.transform(pieces, capital), "")


def relation_label(relation: Column) -> Column:
    return F.translate(relation, "-_", "  ")


def relation_norm(relation: Column) -> Column:
    return F.translate(F.lower(relation), "_", "-")


def impact_label(impact_class: Column, people: Column, radius_km: Column) -> Column:
    label = F.concat(title_case(impact_class), F.lit(" impact · "), F.format_number(people.cast("double"), 0), F.lit(" people within "),
                     F.format_number(radius_km.cast("double"), 0), F.lit(" km · JRC GHSL"))
    return F.when(impact_class.isNotNull() & people.isNotNull() & radius_km.isNotNull(), label)


def embedding_text(title: Column, summary: Column, terms: Column) -> Column:
    """Title, up to 600 characters of summary, and the first eight terms, one per line."""
    parts = F.array(F.coalesce(title, F.lit("")), F.substring(F.coalesce(summary, F.lit("")), 1, 600),
                    F.array_join(F.slice(terms, 1, 8), ", "))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def rationale(mechanism: Column, chain: Column, evidence: Column) -> Column:
    return F.concat(mechanism, F.lit("\n\nCausal chain: "), F.array_join(chain, " → "),
                    F.lit("\n\nEvidence: "), F.array_join(F.slice(evidence, 1, 3), "; "))


def short_sha1(prefix: str, text: Column, length: int = 12) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(text), 1, length))
