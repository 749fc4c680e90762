from .registry import Operator, all_operators, families, get, register

__all__ = ["Operator", "all_operators", "families", "get", "register"]
