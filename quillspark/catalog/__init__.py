"""Named queries over the standard tables, with equivalent SQL where SQL can say the same."""
