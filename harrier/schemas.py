"""The stored tables. race_id is text and orders as text wherever races of a day are ordered."""

from __future__ import annotations

ATHLETES = "fis_code string, name string, nation string, birth_year int, competitor_id string"
RACES = "race_id string, event_id string, season int, race_date date, place string, series string, title string, gender string, kind string, technique string, start_type string, length_km double, is_team boolean"
RESULTS = "race_id string, fis_code string, rank int, bib int, time_s double, diff_s double, fis_points double, status string"
START_LIST = "race_id string, fis_code string, bib int, start_time string, fetched_at timestamp"
RATING_HISTORY = "pool string, race_id string, race_date date, fis_code string, rating double, n_races int"
RATINGS = "fis_code string, pool string, rating double, n_races int, last_race_id string, last_date date"

KEYS = {"athletes": ["fis_code"], "races": ["race_id"], "results": ["race_id", "fis_code"], "start_list": ["race_id", "fis_code"], "ratings": ["fis_code", "pool"], "bad_pages": ["race_id"]}
SCHEMAS = {"athletes": ATHLETES, "races": RACES, "results": RESULTS, "start_list": START_LIST, "ratings": RATINGS, "rating_history": RATING_HISTORY, "bad_pages": "race_id string, error string"}

FEATURES = ("similar_form", "similar_best", "overall_form", "specificity", "experience", "recent_starts", "fis_points", "has_fis_points", "consistency", "similar_margin", "has_margin")
