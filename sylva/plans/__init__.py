"""Trees, and the plans that grow, validate and prune forests of them."""
