"""Column-expression helpers (all JVM-side, codegen friendly)."""

from shopfloor.functions.text import (  # noqa: F401
    CATEGORIES,
    clean_number,
    clean_text,
    format_money,
    is_blank,
    money,
    parse_date,
    python_title,
    search_tokens,
    truncate,
)
from shopfloor.functions.pii import protect, unprotect  # noqa: F401
