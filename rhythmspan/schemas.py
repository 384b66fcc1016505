"""Tables of the library; everything is keyed by ``recording_id``."""

BEATS = "recording_id string, beat_idx long, time_sec double, rr_sec double, qrs_sec double, label string"
SPANS = "recording_id string, start_sec double, end_sec double"
