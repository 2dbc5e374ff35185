"""tagloom: tagging large text collections with a global vocabulary on Spark."""

from tagloom.config import CJK2, WORD, Profile
from tagloom.operators.merge_plans import plan_by_similarity
from tagloom.operators.propose import Facet
from tagloom.plans.maintenance import (
    clear_tags,
    consolidate,
    delete_rows,
    list_tags,
    queue_status,
    status,
)
from tagloom.plans.tagging import (
    Settings,
    lexicon_proposer,
    model_proposer,
    tag_batch,
    terms_proposer,
)
from tagloom.sources.messages import enqueue, read_messages
from tagloom.sources.tables import TableStore
from tagloom.streaming.loop import Queue
from tagloom.streaming.progress import backlog, progress
from tagloom.streaming.tagging import fold_stream, start_tagging_stream

__all__ = [
    "CJK2", "WORD", "Facet", "Profile", "Queue", "Settings", "TableStore", "backlog",
    "clear_tags", "consolidate", "delete_rows", "enqueue", "fold_stream", "lexicon_proposer",
    "list_tags", "model_proposer", "plan_by_similarity", "progress",
    "queue_status", "read_messages", "start_tagging_stream", "status",
    "tag_batch", "terms_proposer",
]
