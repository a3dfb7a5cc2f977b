"""Rule packs: plain data handed to the operators. Nothing here computes anything."""
