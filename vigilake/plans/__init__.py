"""Named queries over the shared tables, each with equivalent SQL."""
