"""Fixed values of the domain: metric vocabularies, axes and thresholds. All are defaults of keyword arguments."""

from __future__ import annotations

# Thresholds.
MIN_MINUTES = 900
MIN_SHOTS_FOR_RATIO = 20
MIN_SHOTS_FACED_FOR_RATIO = 30
MIN_VECTOR_NORM = 0.05
MIN_SAMPLE = 30
STRENGTH_FLOOR = 0.70
WEAKNESS_CEILING = 0.30
NOTABLE_GAP = 0.15
MIN_RADAR_AXES = 3
POPULATION_DRIFT = 1.75
MAX_COMPARE = 4
MAX_AGE, YOUNGEST = 23, 16
LEAGUE_FLOOR = 0.4
PERFORMANCE_WEIGHT, YOUTH_WEIGHT = 0.7, 0.3
MOMENTUM_DAYS = 400
FUZZY_ACCEPT = 0.88
SAME_MOVE_DAYS = 150
RECENT_DAYS = 430
MIN_VALUED_PLAYERS = 50
COEFFICIENT_FLOOR = 0.05
MAX_ARCS = 120
MIN_QUERY, PER_KIND = 2, 6
FORM_WINDOW, FORM_MATCHES = 5, 200

# Metrics counted per 90 minutes, those kept as ratios, and those where less is better.
COUNTING_METRICS = (
    "goals", "assists", "goal_contributions", "xg", "xa", "non_penalty_goals", "non_penalty_xg", "shots",
    "shots_on_target", "key_passes", "xg_chain", "xg_buildup", "fouls", "yellow_cards", "interceptions",
    "tackles_won", "crosses", "fouled", "saves", "goals_against", "shots_on_target_against", "clean_sheets",
)
#: Counting metrics that are columns of a season row rather than entries of its metric map.
COLUMN_METRICS = ("goals", "assists", "xg", "xa")
SHOT_RATIOS = ("shots_on_target_pct", "goals_per_shot")
KEEPER_RATIOS = ("save_pct", "clean_sheet_pct")
NEGATIVE_METRICS = ("fouls", "yellow_cards", "goals_against")
CONTEXT_METRICS = ("fouls", "yellow_cards", "shots_on_target_against")
KEEPER_METRICS = ("saves", "save_pct", "goals_against", "clean_sheets", "clean_sheet_pct")
#: Metrics with a label, which alone are shown.
LABELLED_METRICS = (*COUNTING_METRICS, *SHOT_RATIOS, *KEEPER_RATIOS)

# Axes of the role vector and of each group's radar, in order.
ROLE_AXES = ("non_penalty_goals", "assists", "shots", "crosses", "interceptions", "tackles_won", "fouled", "fouls")
RADAR_AXES = {
    "GK": ("saves", "save_pct", "goals_against", "clean_sheet_pct", "shots_on_target_against"),
    "DF": ("interceptions", "tackles_won", "fouls", "crosses", "assists", "goal_contributions"),
    "MF": ("interceptions", "tackles_won", "assists", "key_passes", "fouled", "goal_contributions"),
    "FW": ("non_penalty_goals", "xg", "shots", "goals_per_shot", "assists", "fouled"),
}

# Words of position labels and their groups, looked up in this order.
POSITION_WORDS = (
    ("goalkeeper", "GK"), ("keeper", "GK"), ("gk", "GK"), ("defender", "DF"), ("defence", "DF"), ("defense", "DF"), ("df", "DF"), ("back", "DF"),
    ("midfielder", "MF"), ("midfield", "MF"), ("mf", "MF"), ("attacker", "FW"), ("attack", "FW"), ("forward", "FW"), ("striker", "FW"), ("winger", "FW"), ("fw", "FW"),
)

# Legal forms, words that name no club, and marks of youth and reserve sides.
LEGAL_FORMS = ("fc", "cf", "ac", "sc", "as", "ss", "ssc", "afc", "cd", "ud", "rc", "rcd", "sv", "tsg", "tsv", "vfl", "vfb", "bsc", "fsv", "sd", "ogc", "calcio", "club", "futbol", "football", "balompie")
CLUB_NOISE = ("yeni", "spor", "kulubu", "jimnastik", "genclik", "belediye", "fk", "sk", "ac", "fc")
YOUTH_MARKS = ("u17", "u18", "u19", "u20", "u21", "u23", "ii", "b", "reserves", "academy")
GENERIC_WORDS = ("yeni", "spor", "kulubu", "jimnastik", "genclik", "belediye")

# Feed types that are no moves, days that stand for a whole window.
NON_MOVES = ("raise", "end of career")
BUCKET_DAYS = ("07-01", "06-30", "01-01", "12-31")

# Columns of the season-statistics source and of the expected-goals source, as metric names.
VOLUME_COLUMNS = {
    "Playing Time Starts": "starts", "Playing Time 90s": "nineties", "Performance G-PK": "non_penalty_goals", "Performance PK": "penalties_scored",
    "Performance CrdY": "yellow_cards", "Performance CrdR": "red_cards", "Standard Sh": "shots", "Standard SoT": "shots_on_target", "Standard SoT%": "shots_on_target_pct",
    "Standard G/Sh": "goals_per_shot", "Performance Fls": "fouls", "Performance Int": "interceptions", "Performance TklW": "tackles_won", "Performance Crs": "crosses",
    "Performance Fld": "fouled", "Performance Recov": "recoveries", "Aerial Duels Won%": "aerial_duels_won_pct", "Performance GA": "goals_against", "Performance SoTA": "shots_on_target_against",
    "Performance Saves": "saves", "Performance Save%": "save_pct", "Performance CS": "clean_sheets", "Performance CS%": "clean_sheet_pct", "Penalty Kicks PKatt": "penalties_faced", "Penalty Kicks PKsv": "penalties_saved",
}
EXPECTED_COLUMNS = {"np_goals": "non_penalty_goals", "np_xg": "non_penalty_xg", "shots": "shots", "key_passes": "key_passes", "xg_chain": "xg_chain", "xg_buildup": "xg_buildup", "yellow_cards": "yellow_cards", "red_cards": "red_cards"}

# Columns that each snapshot must have.
REQUIRED_COLUMNS = {
    "competitions": ("competition_id", "name", "country_name", "type", "sub_type"),
    "clubs": ("club_id", "name", "domestic_competition_id"),
    "players": ("player_id", "name", "date_of_birth", "country_of_citizenship", "position", "sub_position", "foot", "height_in_cm", "current_club_id", "market_value_in_eur", "contract_expiration_date"),
    "transfers": ("player_id", "transfer_date", "from_club_id", "to_club_id", "transfer_fee"),
    "valuations": ("player_id", "date", "market_value_in_eur"),
}
LEAGUE_LOGO = "https://tmssl.akamaized.net/images/logo/header/%s.png"
CLUB_LOGO = "https://tmssl.akamaized.net/images/wappen/head/%s.png"

# Null ratios above which a column is in violation, and violations that are known noise.
NULL_RULES = (
    ("players", "nationality_code", "nationality_code is null", 0.05),
    ("players", "age", "birth_date is null and birth_year is null", 0.05),
    ("players", "market_value_eur", "market_value_eur is null", 0.35),
    ("clubs", "league_id", "league_id is null", 0.01),
    ("player_season_stats", "minutes", "minutes is null", 0.01),
)
INTEGRITY_RULES = (
    ("player_season_stats", "negative minutes", "minutes < 0", 0),
    ("player_season_stats", "minutes over 60 matches", "minutes > 5400", 0),
    ("player_season_stats", "goals over shots", "goals > shots", 50),
    ("player_season_stats", "season row without club", "club_id is null", 0),
    ("player_season_stats", "season row without league", "league_id is null", 0),
    ("players", "born in the future", "birth_date > as_of", 0),
    ("player_match_stats", "over 120 minutes in a match", "minutes > 120", 5),
    ("matches", "match without league", "league_id is null", 0),
    ("shots", "shot outside the pitch", "location_x < 0 or location_x > 1 or location_y < 0 or location_y > 1", 0),
    ("shots", "xg outside 0-1", "xg < 0 or xg > 1", 0),
    ("shots", "goal flag without goal", "is_goal and lower(coalesce(result, '')) <> 'goal'", 0),
)
