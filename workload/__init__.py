"""The driver's tables seen as an inventory, the registered queries over them, and their oracles."""
