"""Plans that tie sources, the parsing stage and the relational rules together."""
