from oddsmith.functions.columns import (
    code_of,
    flag_positive,
    flag_true,
    hash_bound,
    impute,
    keep_listed,
    key_hash,
    literal,
    nan_to_null,
    quoted,
    required_number,
    required_outcome,
)

__all__ = [
    "code_of",
    "flag_positive",
    "flag_true",
    "hash_bound",
    "impute",
    "keep_listed",
    "key_hash",
    "literal",
    "nan_to_null",
    "quoted",
    "required_number",
    "required_outcome",
]
