"""Queries: the operators applied to tables in the roles that `roles` binds."""
