"""Tables that hold blocks, the header log, and generated sales."""
