"""DataFrame operators over lines, baskets, rules and clusters."""
