"""Schemas of the canonical events; readers never infer them."""

from __future__ import annotations

# The fields of the three kinds of events, and of the entries of a stream.
INCIDENT = (
    "event_id string, source_code string, external_id string, category_code string, severity string, title string, description string, latitude double, longitude double, "
    "location_name string, occurred_at timestamp, ingested_at timestamp, raw_payload string"
)
OBSERVATION = (
    "event_id string, source_code string, external_id string, station_code string, station_name string, latitude double, longitude double, observed_at timestamp, water_level_m double, "
    "rainfall_mm double, temperature_c double, humidity_pct double, wind_speed_kmh double, wind_direction_deg int, pressure_hpa double, raw_metrics map<string,string>, ingested_at timestamp"
)
EVIDENCE = (
    "event_id string, source_code string, external_id string, evidence_type string, title string, url string, publisher_domain string, language string, published_at timestamp, "
    "text_snippet string, sha256_hash string, captured_at timestamp"
)
ENTRY = "key string, kind string, data string"
