"""Schemas of the derived tables."""

from __future__ import annotations

LEGAL_MOVE = "struct<from_sq:tinyint,to_sq:tinyint,promotion:tinyint>"


def position_struct(legal_moves: bool = False) -> str:
    more = f",legal_moves:array<{LEGAL_MOVE}>" if legal_moves else ""
    return f"struct<board:array<tinyint>,castling:array<boolean>,en_passant:tinyint,halfmove_clock:smallint,turn:boolean{more}>"


def move_struct(comments: bool = False) -> str:
    more = ",comment:string" if comments else ""
    return f"struct<from_sq:tinyint,to_sq:tinyint,promotion:tinyint,clock:float,eval:float{more}>"


def game_fields(positions: bool = True, comments: bool = False, legal_moves: bool = False, status: bool = True) -> str:
    """The columns that replay adds, as DDL."""
    out = "headers map<string,string>, outcome string, is_valid boolean, parse_error string, num_moves int, num_positions int"
    if status:
        out += ", is_checkmate boolean, is_stalemate boolean, is_insufficient struct<white:boolean,black:boolean>, legal_move_count int"
    if positions or legal_moves:
        out += f", positions array<{position_struct(legal_moves)}>"
    return out + f", moves array<{move_struct(comments)}>"
