"""DataFrame operators the catalog queries are composed from."""
