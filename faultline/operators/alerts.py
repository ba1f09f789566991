"""Alert intake: validation, idempotency keys, deduplication, incident ids, sentences, rate limit.

Deliveries have (delivery_id, received_at, idempotency_key, body); `delivery_id` is unique and
`body` is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import jsonval
from faultline.functions.text import STAMP, iso_time
from faultline.plans.firsts import flag_first
from faultline.plans.folds import fold_slices
from faultline.plans.slices import SLICE_ROWS, settled

FIELDS = ("service", "metric", "value", "timestamp", "incident_id")


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
NO_NUMBER = r"^(?i)([+-]?(inf|infinity)|nan)$"
LAST_SECOND = 253_402_300_799  # of the year 9999


def _value(p: Column) -> Column:
    """Number, numeric text or boolean as double."""
    text = F.trim(jsonval.raw_text(p, "$.value"))
    return F.coalesce(
        jsonval.number(p, "$.value"),
        F.when(text.rlike(NUMBER) | text.rlike(NO_NUMBER), text.try_cast("double")),
        F.when(jsonval.kind_at(p, "$.value") == "BOOLEAN", F.try_variant_get(p, "$.value", "boolean").cast("double")),
    )


def _timestamp(p: Column) -> Column:
    """ISO text, or a number of seconds (milliseconds when too large for seconds), also as text."""
    text = jsonval.raw_text(p, "$.timestamp")
    epoch = F.coalesce(jsonval.number(p, "$.timestamp"), F.when(text.rlike(NUMBER), text.try_cast("double")))
    seconds = F.when(F.abs(epoch) > 2e10, epoch / 1000).otherwise(epoch)
    inside = F.when(F.abs(seconds) <= LAST_SECOND, seconds)
    return F.coalesce(iso_time(text), F.timestamp_micros((inside * 1e6).try_cast("bigint")))


def parse_alerts(deliveries: DataFrame) -> DataFrame:
    """Add the typed fields and `reason`, the first field that fails; null when all are valid."""
    p = F.col("p")
    id_kind = F.coalesce(jsonval.kind_at(p, "$.incident_id"), F.lit("VOID"))
    typed = deliveries.withColumn("p", F.try_parse_json("body")).select(
        *[F.col(name) for name in deliveries.columns],
        jsonval.is_object(p).alias("__object"),
        jsonval.text(p, "$.service").alias("service"),
        jsonval.text(p, "$.metric").alias("metric"),
        _value(p).alias("value"),
        _timestamp(p).alias("timestamp"),
        jsonval.raw_text(p, "$.incident_id").alias("incident_id"),
        id_kind.isin("VOID", "STRING").alias("__id_ok"),
    )
    reason = F.when(~F.col("__object"), "body")
    for name in FIELDS[:4]:
        reason = reason.when(F.col(name).isNull(), name)
    reason = reason.when(~F.col("__id_ok"), "incident_id")
    return settled(typed.withColumn("reason", reason).drop("__object", "__id_ok"))


def scan_alerts(deliveries: DataFrame) -> DataFrame:
    """Accepted alerts."""
    return parse_alerts(deliveries).where(F.col("reason").isNull()).drop("reason", "body")


def alert_rejects(deliveries: DataFrame) -> DataFrame:
    """Rejected deliveries with the reason."""
    return parse_alerts(deliveries).where(F.col("reason").isNotNull()).select("delivery_id", "reason", "body")


def alert_keys(alerts: DataFrame) -> DataFrame:
    """Add `alert_key`: the caller's key, else a digest of the validated fields in fixed order."""
    # JSON: separators inside a name are quoted, absent is null, the number is whole, -0 is 0
    fields = F.to_json(
        F.array(
            F.col("service"),
            F.col("metric"),
            (F.col("value") + F.lit(0.0)).cast("string"),
            F.date_format("timestamp", STAMP),
            F.col("incident_id"),
        )
    )
    given = F.nullif(F.col("idempotency_key"), F.lit(""))
    return alerts.withColumn("alert_key", F.coalesce(given, F.sha2(fields, 256)))


def alert_dedupe(alerts: DataFrame) -> DataFrame:
    """Add `duplicate`: another delivery with the same key was received before."""
    flagged = flag_first(alert_keys(alerts), ["alert_key"], "delivery_id", ["received_at"], "__first")
    return flagged.withColumn("duplicate", ~F.col("__first")).drop("__first")


def alert_incident_ids(alerts: DataFrame) -> DataFrame:
    """Fill missing incident ids from the alert key."""
    keyed = alerts if "alert_key" in alerts.columns else alert_keys(alerts)
    made = F.concat(F.lit("inc-"), F.left(F.col("alert_key"), F.lit(12)))
    return keyed.withColumn("incident_id", F.coalesce(F.nullif(F.col("incident_id"), F.lit("")), made))


def incident_starts(alerts: DataFrame) -> DataFrame:
    """Accepted, first-received alerts with `starts`: it is the one that opens its incident."""
    fresh = alert_incident_ids(alert_dedupe(alerts).where(~F.col("duplicate")))
    return flag_first(fresh, ["incident_id"], "delivery_id", ["received_at"], "starts")


def alert_sentence(deliveries: DataFrame) -> DataFrame:
    """Add one plain sentence per alert body; other objects become a sorted list of their fields."""
    fields = F.from_json("body", "map<string,string>")
    rows = deliveries.withColumn("__f", fields)

    def field(name: str) -> Column:
        return F.nullif(F.try_element_at("__f", F.lit(name)), F.lit(""))

    when = F.coalesce(F.concat(F.lit(" at "), field("timestamp")), F.lit(""))
    known = F.concat(
        F.lit("Alert "),
        F.coalesce(field("incident_id"), F.lit("")),
        F.lit(": service "),
        field("service"),
        F.lit(" metric "),
        field("metric"),
        F.lit(" breached with value "),
        F.try_element_at("__f", F.lit("value")),
        when,
        F.lit("."),
    )
    listed = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("__f")),
            lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("None"))),
        ),
        ", ",
    )
    other = F.concat(F.lit("Incident alert with "), listed, F.lit("."))
    return rows.withColumn("sentence", F.coalesce(known, other)).drop("__f")


SECOND = 1_000_000  # microseconds
BEFORE = -(1 << 62)  # requests without a time come before all others


def bucket_sizes(limit: int, window_seconds: float) -> tuple[int, int]:
    """(a full bucket, one token) in parts of which a microsecond adds `limit`: whole numbers keep sums exact."""
    token = round(window_seconds * SECOND)
    return limit * token, token


def bucket_step(limit: int, window_seconds: float):
    """One request against a bucket: state is (parts left, last time), output (allowed, retry_after)."""
    full, token = bucket_sizes(limit, window_seconds)

    def step(state: tuple[int, int] | None, value: tuple[int]) -> tuple[tuple, tuple]:
        now = int(value[0])
        left = full if state is None else min(full, int(state[0]) + (now - int(state[1])) * limit)
        if left >= token:
            return (left - token, now), (True, None)
        return (left, now), (False, (token - left) / limit / SECOND)

    return step


def bucket_outline(limit: int, window_seconds: float):
    """What a run of requests does to any bucket.

    With y parts before the first request a bucket ends with y + c or with a constant: pieces
    (from, slope, c) over y. A bucket holds at most `limit` tokens, and pieces begin where buckets
    come to differ by a whole token or to be full alike: a few for each token of the limit.
    """
    full, token = bucket_sizes(limit, window_seconds)

    def outline(requests: list[tuple[int]]) -> dict:
        pieces, last = [(0, 1, 0)], None
        for (now,) in requests:
            now = int(now)
            gain = 0 if last is None else (now - last) * limit
            last, made = now, []
            for n, (low, slope, c) in enumerate(pieces):
                high = pieces[n + 1][0] if n + 1 < len(pieces) else full + 1
                c += gain
                # where this piece fills the bucket, then where it has a token
                parts = [(low, slope, c)] if slope else [(low, 0, min(c, full))]
                if slope and full - c < high:
                    parts = ([(low, 1, c)] if low < full - c else []) + [(max(low, full - c), 0, full)]
                for m, (begin, slope, c) in enumerate(parts):
                    end = parts[m + 1][0] if m + 1 < len(parts) else high
                    if not slope:
                        made.append((begin, 0, c - token if c >= token else c))
                        continue
                    if begin < token - c:
                        made.append((begin, 1, c))
                    if token - c < end:
                        made.append((max(begin, token - c), 1, c - token))
            pieces = [piece for n, piece in enumerate(made) if not n or piece[1:] != made[n - 1][1:]]
        return {"first": int(requests[0][0]), "last": last, "pieces": pieces}

    return outline


def bucket_enter(limit: int, window_seconds: float):
    """The state that an outlined run leaves after a given one."""
    full, _ = bucket_sizes(limit, window_seconds)

    def enter(state: tuple | None, outlined: dict) -> tuple:
        left = full if state is None else min(full, state[0] + (outlined["first"] - state[1]) * limit)
        _, slope, c = max(piece for piece in outlined["pieces"] if piece[0] <= left)
        return slope * left + c, outlined["last"]

    return enter


def token_bucket(
    requests: DataFrame,
    limit: int,
    window_seconds: float = 60.0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Allow or throttle requests (client, request_id, ts) with one bucket per client.

    A bucket holds `limit` tokens and gains `limit` per window. A client that holds most requests
    is folded in slices; what each does to any bucket is found first.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(BEFORE))
    decided = fold_slices(
        requests.select("client", "request_id", "ts", at.alias("t")),
        ["client"],
        "ts",
        ["request_id"],
        bucket_step(limit, window_seconds),
        bucket_outline(limit, window_seconds),
        bucket_enter(limit, window_seconds),
        ["t"],
        ["allowed", "retry_after"],
        "client string, request_id bigint, allowed boolean, retry_after double",
        ["client", "request_id"],
        slice_rows,
    )
    whole = F.greatest(F.lit(1), F.ceil("retry_after")).cast("bigint")
    return decided.withColumn("retry_after_seconds", F.when(~F.col("allowed"), whole))
