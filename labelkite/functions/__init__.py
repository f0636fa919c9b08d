"""Column expressions."""

from labelkite.functions.text import (  # noqa: F401
    clean_text,
    join_tokens,
    keyword,
    parent_folder,
    room_name,
    tokenize,
)
from labelkite.functions.values import (  # noqa: F401
    encode_label,
    missing_token,
    safe_double,
    safe_int,
    trim_blanks,
    unit_hash,
)
