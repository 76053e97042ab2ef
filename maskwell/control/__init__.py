"""Projects, audit, signatures, checkpointed and batch runs."""
