"""Agent-status snapshots: objects written one after the other with nothing between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SNAPSHOT

# Fixed values of the snapshot format.
SEAM = '}{"AWSAccountId'
REPAIRED_SEAM = '},{"AWSAccountId'
ROUTABLE = "ROUTABLE"

SNAPSHOT_LIST = f"ARRAY<STRUCT<{SNAPSHOT}>>"


def repaired(text: Column | str) -> Column:
    """Back-to-back objects made into one JSON array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("["), F.replace(text, F.lit(SEAM), F.lit(REPAIRED_SEAM)), F.lit("]"))


def _array(text: Column) -> Column:
    """Parse an array of snapshots; NULL unless the text is well-formed as a whole.

    The parser stops at the end of the first value, so the array is followed by a mark that
    is reached only if nothing comes between.
    """
    marked = F.concat(F.lit('{"all":'), text, F.lit(',"end":1}'))
    found = F.from_json(marked, f"all {SNAPSHOT_LIST}, end INT")
    return F.when(found["end"] == 1, found["all"])


def parsed(text: Column | str) -> Column:
    """Array of snapshots; NULL for malformed text."""
    return _array(repaired(text))


def parsed_piece(piece: Column | str) -> Column:
    """One snapshot out of a file that was split at the seams.

    The reader takes the seam away, so a piece may lack its opening (all but the
    first) and its closing brace (all but the last).
    """
    piece = F.col(piece) if isinstance(piece, str) else piece
    start = F.when(F.ltrim(piece).startswith("{"), piece).otherwise(F.concat(F.lit(SEAM[1:]), piece))
    inner = _array(F.concat(F.lit("["), start, F.lit("}]")))
    last = _array(F.concat(F.lit("["), start, F.lit("]")))
    return F.get(F.coalesce(inner, last), F.lit(0))


def user(snapshot: Column | str) -> Column:
    return _field(snapshot, "CurrentAgentSnapshot.Configuration.Username")


def can_take_a_case(snapshot: Column | str) -> Column:
    """Routable with a free slot in the first channel; false where any part is missing."""
    status = _field(snapshot, "CurrentAgentSnapshot.AgentStatus.Type")
    channels = _field(snapshot, "CurrentAgentSnapshot.Configuration.RoutingProfile.Concurrency")
    slots = F.get(channels, F.lit(0))["AvailableSlots"]
    return F.coalesce((status == ROUTABLE) & (slots > 0), F.lit(False))


def _field(snapshot: Column | str, path: str) -> Column:
    col = F.col(snapshot) if isinstance(snapshot, str) else snapshot
    for name in path.split("."):
        col = col[name]
    return col
