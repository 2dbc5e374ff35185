"""Limits, thresholds and tag profiles.

The values in the first block are fixed: results only agree with the tagging
service this engine stands in for when they keep these defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
SIMILARITY_THRESHOLD = 0.8      # normalised edit similarity that counts as a match
MAX_TAGS = 3000                 # size limit of the global vocabulary
MAX_TEXT_CHARS = 2000           # text handed to a model per snippet
LINES_PER_REPLY = 4             # reply lines looked at per facet
TAGS_PER_SNIPPET = 12           # tags kept per snippet over all facets
CHUNK_SIZE = 50                 # snippets per enqueue chunk
CONSUMER_BATCH = 10             # snippets worked on together by a consumer
BATCH_SIZE = 10                 # snippets per keyset page
MAX_RETRIES = 3                 # retries before a message is a dead letter
RETRY_DELAY_SECONDS = 60        # delay of an ordinary retry
BACKOFF_BASE_SECONDS = 30       # first delay after a capacity error
BACKOFF_CAP_SECONDS = 300       # longest delay after a capacity error
MERGES_PER_GROUP = 10           # tags merged into one primary tag
DEFAULT_REASON = "No reason provided"
MESSAGE_PRIORITY = "medium"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """What a tag may look like.

    ``dropped`` is the character class removed while cleaning, ``valid`` the
    pattern a cleaned tag has to match, ``none_word`` the reply line that means
    "no tag", ``max_length`` the longest cleaned tag considered at all.
    """

    name: str
    dropped: str
    valid: str
    max_length: int
    none_word: str


# --- fixed values: kept characters, tag shape and the "none" word ------------
CJK2 = Profile(
    name="cjk2",
    dropped=r"[^\u0030-\u3134\u3400-\u4dbf\u4e00-\u9fff]",
    valid=r"^[\u4e00-\u9fff]{2}\z",
    max_length=4,
    none_word="无",
)
# ----------------------------------------------------------------------------

WORD = Profile(
    name="word",
    dropped=r"[^A-Za-z]",
    valid=r"^[A-Za-z]{5,12}\z",
    max_length=12,
    none_word="none",
)
