"""Declared schemas of every input (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# Raw play-log export record (one JSON object per play). Field names are fixed
# values: they must equal the export format's keys.
RAW_PLAY = T.StructType([
    _f("ts", S), _f("platform", S), _f("ms_played", L), _f("conn_country", S), _f("ip_addr_decrypted", S),
    _f("master_metadata_track_name", S), _f("master_metadata_album_artist_name", S),
    _f("master_metadata_album_album_name", S), _f("spotify_track_uri", S), _f("episode_name", S),
    _f("episode_show_name", S), _f("spotify_episode_uri", S), _f("reason_start", S), _f("reason_end", S),
    _f("shuffle", B), _f("skipped", B), _f("offline", B), _f("offline_timestamp", L), _f("incognito_mode", B),
])

# Flags of a play; the export's readers take a missing flag as false.
PLAY_FLAGS = ("shuffle", "skipped", "offline", "incognito_mode")

_ID = T.StructType([_f("id", S)])
_IMAGE = T.StructType([_f("url", S)])

TRACK_DOC = T.StructType([
    _f("id", S), _f("name", S), _f("duration_ms", L), _f("explicit", B), _f("popularity", I),
    _f("track_number", I), _f("disc_number", I),
    _f("album", T.StructType([_f("id", S), _f("artists", T.ArrayType(_ID))])),
    _f("artists", T.ArrayType(_ID)),
])

ARTIST_DOC = T.StructType([
    _f("id", S), _f("name", S), _f("followers", T.StructType([_f("total", I)])),
    _f("genres", T.ArrayType(S)), _f("popularity", I), _f("images", T.ArrayType(_IMAGE)),
])

_VALUE = T.StructType([_f("value", S)])
KG_BINDING = T.StructType([_f("item", _VALUE), _f("propLabel", _VALUE), _f("valueLabel", _VALUE)])
KG_DOC = T.StructType([_f("results", T.StructType([_f("bindings", T.ArrayType(KG_BINDING))]))])

ALBUM_DOC = T.StructType([
    _f("id", S), _f("name", S), _f("album_type", S), _f("label", S), _f("release_date", S),
    _f("release_date_precision", S), _f("total_tracks", I), _f("popularity", I),
    _f("artists", T.ArrayType(_ID)),
    _f("tracks", T.StructType([_f("items", T.ArrayType(_ID))])),
    _f("images", T.ArrayType(_IMAGE)),
])

# Cleaned play fact as written to CSV (S7): ts as text.
PLAY_CSV = T.StructType([
    _f("track_id", S), _f("track_name", S), _f("artist_name", S), _f("album_name", S), _f("ts", T.TimestampNTZType()),
    _f("ms_played", L), _f("reason_start", S), _f("reason_end", S), _f("full_play", B), _f("conn_country", S),
    _f("platform", S), _f("shuffle", B), _f("offline", B), _f("incognito_mode", B),
])
