"""Column expressions of the jobs.  Every function takes columns or their names and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: How much each authority's word counts.
AUTHORITY_WEIGHTS = {"official": 1.0, "operator": 0.97, "reference": 0.72}
OTHER_AUTHORITY = 0.62


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(col(x), F.lit(low))))


def slug(x: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def authority_weight(authority: Column | str) -> Column:
    out = F.lit(OTHER_AUTHORITY)
    for name, weight in AUTHORITY_WEIGHTS.items():
        out = F.when(col(authority) == name, F.lit(weight)).otherwise(out)
    return out


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a))))  # least() alone would pass over a null


def floor_time(ts: Column | str, minutes: int) -> Column:
    """Time rounded down to a bucket of so many minutes."""
    width = minutes * 60_000_000
    return F.timestamp_micros(F.expr(f"(unix_micros({ts}) div {width}) * {width}") if isinstance(ts, str) else F.floor(F.unix_micros(ts) / width) * width)


def train_parts(number: Column | str) -> Column:
    """``012/13`` is the set of ``12`` and ``13``."""
    return F.transform(F.split(col(number), "/"), lambda p: F.ltrim(p, F.lit("0")))


def same_train(left: Column | str, right: Column | str) -> Column:
    return F.arrays_overlap(train_parts(left), train_parts(right))


#: Minutes up to which a report counts as fresh, to be watched, degraded and stale.
FRESH, WATCH, DEGRADED, STALE = 30, 60, 90, 180


def freshness_class(age_minutes: Column | str) -> Column:
    age = F.greatest(F.lit(0.0), col(age_minutes))
    return F.when(age <= FRESH, "fresh").when(age <= WATCH, "watch").when(age <= DEGRADED, "degraded").when(age <= STALE, "stale").otherwise("expired")


def freshness_factor(age_minutes: Column | str) -> Column:
    """1 while fresh, then straight lines down to 0.8, 0.5 and 0.3 at the class bounds, 0 when expired."""
    age = F.greatest(F.lit(0.0), col(age_minutes))
    return F.when(age <= FRESH, 1.0).when(age <= WATCH, F.greatest(F.lit(0.8), 1 - (age - FRESH) / 150)).when(age <= DEGRADED, F.greatest(F.lit(0.5), 0.8 - (age - WATCH) / 100)).when(age <= STALE, F.greatest(F.lit(0.3), 0.5 - (age - DEGRADED) / 450)).otherwise(0.0)


def daypart(ts: Column | str) -> Column:
    hour = F.hour(col(ts))
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "day").otherwise("evening")


def horizon(minutes: Column | str) -> Column:
    m = col(minutes)
    return F.when(m <= 30, "short").when(m <= 120, "medium").otherwise("long")


def season(ts: Column | str) -> Column:
    month = F.month(col(ts))
    return F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("autumn")


def nearest_clock(ts: Column | str, minute_of_day: Column | str) -> Column:
    """The moment with this clock time, of the days before, at and after ``ts``, that lies nearest; the earlier of two."""
    base, day = F.unix_micros(col(ts)), 86_400_000_000
    midnight = F.floor(base / day) * day
    options = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: midnight + d * day + col(minute_of_day) * 60_000_000)
    best = F.array_min(F.transform(options, lambda t: F.struct(F.abs(t - base).alias("gap"), t.alias("t"))))
    return F.timestamp_micros(best["t"].cast("long"))


def token_overlap(left: Column | str, right: Column | str) -> Column:
    """Shared words over the words of the shorter side."""
    a, b = (F.array_distinct(F.split(slug(x), "-")) for x in (left, right))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def name_match(left: Column | str, right: Column | str) -> Column:
    """Equal slugs, or one edit apart when both have at least five characters."""
    a, b = slug(left), slug(right)
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1)
    return (a == b) | near


def delay_minutes(text: Column | str) -> Column:
    """Minutes of delay in a text: ``1 h 20 min``, ``+15``, ``15 min``; clock times are no delays; null beyond a day."""
    t = F.lower(col(text))
    masked = F.regexp_replace(t, r"(?<!\+)\b\d{1,2}:\d{2}\b", " ")
    both = F.regexp_extract(masked, r"(\d{1,2})\s*h(?:ours?)?(?:\s*(\d{1,2})\s*min)?", 1)
    rest = F.regexp_extract(masked, r"(\d{1,2})\s*h(?:ours?)?(?:\s*(\d{1,2})\s*min)?", 2)
    plain = F.regexp_extract(masked, r"(?:\+\s*(\d{1,4}))|(?:(\d{1,4})\s*min)", 0)
    number = F.regexp_extract(plain, r"\d+", 0)
    out = F.when(both != "", both.try_cast("int") * 60 + F.coalesce(rest.try_cast("int"), F.lit(0))).when(number != "", number.try_cast("int"))
    return F.when(out.between(0, 1440), out)


def decode_entities(x: Column | str) -> Column:
    out = col(x)
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def strip_tags(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(decode_entities(F.regexp_replace(col(x), "<[^>]*>", " ")), r"\s+", " "), "^ | $", ""))


def route_ends(x: Column | str) -> Column:
    """``origin, destination`` of a route written with a dash or arrow."""
    parts = F.transform(F.split(col(x), r"\s*(?:->|—|–|\s-\s)\s*"), lambda p: F.trim(p))
    return F.struct(F.element_at(parts, 1).alias("origin"), F.element_at(parts, -1).alias("destination"))


def status_of(text: Column | str, rules: list[tuple[str, str]], other: str) -> Column:
    """The first rule whose pattern the text holds."""
    out = None
    for pattern, name in rules:
        hit = F.lower(col(text)).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def registry_state(operational: Column | str, evidence: Column | str, departing: Column) -> Column:
    """What a registry shows for an update."""
    o, e = col(operational), col(evidence)
    return (
        F.when(o == "depot", "depot").when(e == "station-board-window", F.when(departing, "expected_at_station").otherwise("at_station")).when(e == "reported-station-passage", F.when(o == "moving", "moving").otherwise("at_station"))
        .when(o == "moving", "moving").when((e == "schedule-only") | (o == "planned"), "planned").otherwise("unobserved")
    )


def quality_score(age_minutes: Column | str, has_route: Column, has_forecast: Column, reliability: Column, anchor_error_km: Column) -> Column:
    """0.3 source age, 0.28 route, 0.24 forecast, 0.18 reliability."""
    age = col(age_minutes)
    source = F.when(age <= 20, 1.0).when(age <= 45, 0.72).when(age <= 120, 0.42).otherwise(0.18)
    route = F.when(has_route, F.greatest(F.lit(0.48), 1 - F.least(anchor_error_km, F.lit(140)) / 210)).otherwise(0.0)
    return clamp(source * 0.3 + route * 0.28 + has_forecast.cast("double") * 0.24 + reliability * 0.18)


#: Minutes a depot, a destination and a stop are held.
DWELL = {"depot": 720, "destination": 180, "stop": 60}


#: Words left out of station names, endings of passenger stations, and all spellings of an apostrophe.
STATION_WORDS = ("станція", "станция", "station", "вокзал", "залізнична", "железнодорожная")
PASSENGER_ENDINGS = ("пас", "пасажирський", "пасс", "пассажирский", "головний", "главный")
PASSENGER_FORMS = ("пас", "пасажирська", "пасажирський", "пасс", "пассажирская", "пассажирский")
#: The short passenger ending is also listed in full.
SHORT_ENDING, FULL_ENDING = "пас", "пасажирська"
APOSTROPHES = "[’'`]"


def alias_key(name: Column | str) -> Column:
    """A station name as a key: lower case, one apostrophe, no filler words, runs of other signs as one hyphen."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), APOSTROPHES, "ʼ")
    plain = F.regexp_replace(plain, rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(STATION_WORDS)})($|[^\p{{L}}\p{{N}}])", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def alias_variants(name: Column | str) -> Column:
    """Keys under which a station may be listed: its own, without a passenger ending, with the short one in full, with a trailing number joined."""
    key = alias_key(name)
    short = F.regexp_replace(key, rf"-({'|'.join(PASSENGER_ENDINGS)})$", "")
    joined = F.regexp_replace(key, r"-([0-9]+)$", "$1")
    full = F.when(key.endswith(f"-{SHORT_ENDING}"), F.regexp_replace(key, f"{SHORT_ENDING}$", FULL_ENDING))
    return F.array_distinct(F.array_compact(F.array(F.when(key != "", key), F.when((key != "") & (F.length(short) >= 3), short), full, F.when(key != "", joined))))


def station_match(left: Column | str, right: Column | str) -> Column:
    """Equal keys, equal without a passenger ending, or one edit apart when both have at least five characters."""
    a, b = alias_key(left), alias_key(right)
    bare = lambda k: F.regexp_replace(k, rf"-({'|'.join(PASSENGER_FORMS)})$", "")
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b) <= 1)
    return (a != "") & (b != "") & ((a == b) | (bare(a) == bare(b)) | near)


#: Parts of a source's name and the independent domain it speaks for; the first that is found counts.
SOURCE_DOMAINS = (("uz-public", "uz-official"), ("official-board", "uz-official"), ("anytrain-uz", "uz-official"), ("trusted-collector", "trusted-board"), ("station-edge", "trusted-board"), ("telegram", "telegram"), ("freight-tg", "telegram"), ("^tg-", "telegram"), ("operator", "operator"), ("operations-hub", "operator"))


def source_domain(source: Column | str, domains: tuple[tuple[str, str], ...] = SOURCE_DOMAINS) -> Column:
    """The domain of a source; sources of one domain do not confirm each other."""
    name = slug(F.coalesce(col(source), F.lit("")))
    out = None
    for part, domain in domains:
        out = F.when(name.rlike(part), domain) if out is None else out.when(name.rlike(part), domain)
    return out.when(name != "", name).otherwise("unknown")


def fnv1a(text: Column | str) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, as eight hexadecimal digits."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(F.filter(F.split(col(text), ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)), 8, "0"))


#: Statuses that hold a run where it is.
HOLD_STATUSES = ("held", "hold", "stopped", "suspended", "station", "at-station", "dwelling", "waiting", "depot")


def disruption(operational: Column | str, text: Column | str, delay: Column | str, age_minutes: Column | str, pattern: str) -> Column:
    """State, hold, delay of at most a day, confidence and reasons; ``pattern`` says which texts speak of a hold."""
    held = F.lower(F.trim(F.coalesce(col(operational), F.lit("")))).isin(*HOLD_STATUSES) | F.coalesce(F.lower(col(text)).rlike(pattern), F.lit(False))
    late = F.when(col(delay) > 0, F.least(F.lit(1440), col(delay))).otherwise(0)
    confidence = F.when(held, F.greatest(F.lit(0.45), F.exp(-F.greatest(F.lit(0.0), F.coalesce(col(age_minutes), F.lit(0.0))) / 240))).when(late > 0, 0.7).otherwise(1.0)
    reasons = F.array_compact(F.array(F.when(held, "explicit-operational-hold"), F.when(late >= 60, "material-delay")))
    return F.struct(F.when(held, "held").when(late > 0, "delayed").otherwise("normal").alias("state"), held.alias("held"), late.alias("delay_minutes"), F.round(confidence, 6).alias("confidence"), reasons.alias("reasons"))


def station_lifecycle(cancelled: Column, departed: Column, station: Column | str, operational: Column | str, at_destination: Column, stopped: Column, evidence: Column | str, age_minutes: Column | str) -> Column:
    """One of nine phases of a run: cancelled, depot, departed, completed, dwelling, passed, last-seen, scheduled, in-transit."""
    seen, depot = col(station).isNotNull(), F.coalesce(col(operational) == "depot", F.lit(False))
    destination, stop = (F.coalesce(x, F.lit(False)) for x in (at_destination, stopped))
    held = lambda name, limit: F.when(col(age_minutes) <= limit, name).otherwise("last-seen")
    return (
        F.when(cancelled, "cancelled").when(seen & depot, held("depot", DWELL["depot"])).when(seen & departed, "departed").when(seen & destination, held("completed", DWELL["destination"]))
        .when(seen & stop, held("dwelling", DWELL["stop"])).when(seen, "passed").when(col(evidence) == "station-board-window", "scheduled").otherwise("in-transit")
    )
