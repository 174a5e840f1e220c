"""Column functions."""

from .dates import age_at, birth_bounds, date_is_exact, normalise_season, season_from_start_year, season_label, season_of_date
from .football import groups_in, per_90, position_group, resolve_position_group, rounded, zone_of
from .text import as_date, as_int, as_number, as_text, club_key, club_tokens, fold, is_youth_team, normalize_name, same_club, same_person, search_terms, surname_key

__all__ = [
    "age_at", "as_date", "as_int", "as_number", "as_text", "birth_bounds", "club_key", "club_tokens", "date_is_exact", "fold", "groups_in", "is_youth_team",
    "normalise_season", "normalize_name", "per_90", "position_group", "resolve_position_group", "rounded", "same_club", "same_person", "search_terms", "season_from_start_year",
    "season_label", "season_of_date", "surname_key", "zone_of",
]
