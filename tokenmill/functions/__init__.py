"""Column-expression helpers (JVM-side, codegen friendly)."""

from tokenmill.functions.exprs import (  # noqa: F401
    WORD_PATTERN,
    ids_digest,
    md5_key,
    md5_uniform,
    normalise_ws,
    pad_or_cut_expr,
    round6,
    words_of,
)
