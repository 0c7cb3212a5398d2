"""Column functions: annotation grammar, headers and move notation as built-in expressions."""

from .annotations import annotation, annotation_items, clock_seconds, comment_clock, comment_eval, comment_text, items_clock, items_eval, items_text
from .binding import let
from .headers import header, header_map, tag_list, tag_value, tags_map, termination
from .notation import game_over, square_name, uci, uci_list

__all__ = [
    "annotation", "annotation_items", "clock_seconds", "comment_clock", "comment_eval", "comment_text", "game_over", "header", "header_map", "items_clock", "items_eval",
    "items_text", "let", "square_name", "tag_list", "tag_value", "tags_map", "termination", "uci", "uci_list",
]
