"""Detection on arriving logs."""
