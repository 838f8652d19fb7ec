from oddsmith.sources.tables import (
    pull_jdbc,
    pull_sql,
    read_table,
    replace_table,
    save_local_frame,
)

__all__ = ["pull_jdbc", "pull_sql", "read_table", "replace_table", "save_local_frame"]
